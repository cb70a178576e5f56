"""Toxicity severity by cumulative-link ordinal regression over sparse text features.

*Features*: the presence of words and of word beginnings of four to six
letters (lower-cased), so that inflected and unseen forms share weights.

*Training sample*: per class at most ``SAMPLE_ROWS`` labelled rows, the ones
whose ids hash lowest (a fixed, order-free choice).  Feature counts over the
sample are a Spark aggregate; at most ``MAX_FEATURES`` features that are
associated with the toxic label (log-likelihood ratio) are kept, and only the
rows' indices of those reach the driver, so what it gathers is bounded.
Near-copies in the sample are left out first, since a page copied a hundred
times would make all of its words look like evidence: a row goes when a row of
its own class with a smaller id, the first of one of its bands of min-hashes,
shares 0.8 of their five-word shingles.  Of rows that share an id the one with
the least text counts.

*Grades*: the labels say toxic or not.  Toxic rows are graded 1, 2 or 3 by
terciles of the evidence that the *other* half of the sample gives against them
(log odds of their features there), so a row's grade does not come from its own
label or from the weights that are fitted to it; clean rows are grade 0.

*Model*: ``P(grade <= k) = sigmoid(threshold_k - w x)``.  One weight vector is
shared by all grades, thresholds are ordered by construction; fitted by Adam
on the penalised likelihood from a fixed start.  The expected severity is the
sum over k of ``P(grade >= k)``.  A document is rejected when
``P(grade >= 1)`` reaches the cut that separates the sample's classes best,
each class weighing the same.

Scoring is one pass over the documents without a shuffle; the model is a
few thousand numbers.

Defined results: null, empty and letterless texts have no features and get the
score of an empty feature set; null ids are scored like any other; repeated
labels of a document count as toxic if one does; null labels are ignored; if
the labels lack one of the classes nothing is rejected and every severity is
0.  An empty table gives no rows; extra columns pass through.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.common import fresh, make_room, named, shared

SAMPLE_ROWS = 2_500        # labelled rows of each class in the training sample
MAX_FEATURES = 2_048
MIN_ROWS = 6               # sample rows that a feature must occur in
MIN_ASSOCIATION = 30.0     # log-likelihood ratio that a feature must reach
BANDS, BAND_ROWS = 6, 3    # min-hashes that tell copies in the sample
COPY_WORDS, COPY_SIMILARITY = 5, 0.8
ROWS_AT_ONCE = 64
BEGINNINGS = (4, 5, 6)
GRADES = 4
CACHE_ENTRIES = 300_000

_MULTIPLIERS = [xxhash.xxh64_intdigest(b"min-hash", i) | 1 for i in range(BANDS * BAND_ROWS)]
_LETTERS = re.compile(r"[^\W\d_]+")


def features(token: str) -> list[str]:
    """The features of a lower-cased token: its words, and their beginnings."""
    out = []
    for word in _LETTERS.findall(token):
        out.append("=" + word)
        out += [word[:n] for n in BEGINNINGS if len(word) >= n]
    return out


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    thresholds: tuple[float, ...]   # ascending; empty when nothing could be learnt
    cut: float

    def grade_chances(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k), k = 1.., one row for each score."""
        return 1 / (1 + np.exp(np.asarray(self.thresholds)[None, :] - score[:, None]))


def training_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str,
                    rows: int) -> DataFrame:
    """(doc, toxic, features) of at most ``rows`` labelled documents of each class, one row for each id."""
    known = (labels.filter(named(id_col).isNotNull() & named(label_col).isNotNull())
             .groupBy(named(id_col).alias("doc")).agg(F.max((named(label_col) > 0).cast("int")).alias("toxic")))
    lots = [known.filter(F.col("toxic") == c).orderBy(F.xxhash64("doc"), "doc").limit(rows) for c in (0, 1)]
    kind = pa.struct([("features", pa.list_(pa.string())), ("bands", pa.list_(pa.int64())),
                      ("shingles", pa.list_(pa.int64()))])

    @F.arrow_udf("features array<string>, bands array<bigint>, shingles array<bigint>")
    def present(texts: pa.Array) -> pa.Array:
        make_room()
        # a few rows at a time: as Python objects, a batch's features take ten times its size
        parts = [pa.array([described(t) for t in texts.slice(at, ROWS_AT_ONCE).to_pylist()], kind)
                 for at in range(0, len(texts), ROWS_AT_ONCE)]
        return pa.concat_arrays(parts) if parts else pa.array([], kind)

    chosen = F.broadcast(lots[0].unionByName(lots[1]))   # at most 2 x rows ids
    # of the rows that share an id the least text stands for all, before anything is gathered
    sample = shared(docs.select(named(id_col).alias("doc"), F.coalesce(named(text_col), F.lit("")).alias("text"))
                    .join(chosen, "doc").groupBy("doc", "toxic").agg(F.min("text").alias("text"))
                    .select("doc", "toxic", present("text").alias("p")).select("doc", "toxic", "p.*"))
    band = sample.select("doc", "toxic", F.explode("bands").alias("band"))
    first = band.groupBy("toxic", "band").agg(F.min("doc").alias("first"))
    # Bands only propose: a row is a copy of its band's first row where their five-word shingles agree by 0.8.
    pairs = band.join(first, ["toxic", "band"]).filter("doc > first").select("doc", "first").distinct()
    texts = sample.select("doc", "shingles")
    both = (pairs.join(texts, "doc").join(texts.select(F.col("doc").alias("first"), F.col("shingles").alias("others")),
                                          "first"))
    shared_part = F.size(F.array_intersect("shingles", "others"))
    copies = both.filter(shared_part >= COPY_SIMILARITY * F.size(F.array_union("shingles", "others"))).select("doc").distinct()
    return shared(sample.join(copies, "doc", "left_anti").select("doc", "toxic", "features"))


def described(text: str) -> dict:
    """Features of a text, the bands of their min-hashes, and the hashes of its five-word shingles."""
    words = text.lower().split()
    found = sorted({f for w in set(words) for f in features(w)})
    shingles = {" ".join(words[i:i + COPY_WORDS]) for i in range(max(1, len(words) - COPY_WORDS + 1))}
    return {"features": found, "bands": bands(found),
            "shingles": sorted(xxhash.xxh64_intdigest(s) >> 1 for s in shingles)}


def bands(names: list[str]) -> list[int]:
    """Digests of groups of min-hashes: sets that are nearly equal share one almost surely."""
    if not names:
        return []
    hashes = np.array([xxhash.xxh64_intdigest(f) for f in names], dtype=np.uint64)
    least = [(hashes * np.uint64(m) + np.uint64(m >> 7)).min() for m in _MULTIPLIERS]
    return [xxhash.xxh64_intdigest(np.array([i, *least[i * BAND_ROWS:(i + 1) * BAND_ROWS]], dtype="<u8").tobytes()) >> 1
            for i in range(BANDS)]


def associated(sample: DataFrame, toxic_rows: int, clean_rows: int) -> list[str]:
    """The features that go with the toxic label most, strongest first (ties by name)."""
    n = toxic_rows + clean_rows
    counts = (sample.select("toxic", F.explode("features").alias("feature")).groupBy("feature")
              .agg(F.sum("toxic").cast("double").alias("a"), F.count(F.lit(1)).cast("double").alias("r")))

    def term(observed: Column, expected: Column) -> Column:
        return F.when(observed > 0, observed * F.log(observed / expected)).otherwise(0.0)

    a, r = F.col("a"), F.col("r")
    ratio = 2 * (term(a, r * toxic_rows / n) + term(r - a, r * clean_rows / n)
                 + term(toxic_rows - a, (n - r) * toxic_rows / n)
                 + term(clean_rows - (r - a), (n - r) * clean_rows / n))
    best = (counts.filter((r >= MIN_ROWS) & (a * n > r * toxic_rows)).withColumn("ratio", F.round(ratio, 6))
            .filter(F.col("ratio") >= MIN_ASSOCIATION).orderBy(F.col("ratio").desc(), "feature").limit(MAX_FEATURES))
    return [x["feature"] for x in best.select("feature").collect()]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic", rows: int = SAMPLE_ROWS) -> Model:
    sample = training_sample(docs, labels, id_col, text_col, label_col, rows)
    size = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not size.get(0) or not size.get(1):
        return Model({}, (), 1.0)
    names = associated(sample, size[1], size[0])
    kept = F.array(*[F.lit(f) for f in names]) if names else F.expr("array()").cast("array<string>")
    table = (sample.select("doc", "toxic", F.array_intersect("features", kept).alias("features"))
             .orderBy("doc", "toxic").collect())      # at most 2 x rows rows of selected features
    at = {f: i for i, f in enumerate(names)}
    rows_at = np.array([i for i, r in enumerate(table) for _ in r["features"]], dtype=np.int64)
    cols_at = np.array([at[f] for r in table for f in r["features"]], dtype=np.int64)
    toxic = np.array([r["toxic"] for r in table])
    evidence = _evidence(rows_at, cols_at, toxic, np.arange(len(table)) % 2, len(names))
    terciles = np.quantile(evidence[toxic == 1], [1 / 3, 2 / 3])
    grade = np.where(toxic == 1, 1 + (evidence > terciles[0]) + (evidence > terciles[1]), 0)
    weights, thresholds = _fit_cumulative(rows_at, cols_at, grade, len(names))
    chance = 1 / (1 + np.exp(thresholds[0] - np.bincount(rows_at, weights[cols_at], minlength=len(table))))
    return Model(dict(zip(names, weights.tolist())), tuple(thresholds.tolist()), _cut(chance, toxic))


def _evidence(rows: np.ndarray, cols: np.ndarray, toxic: np.ndarray, fold: np.ndarray, width: int) -> np.ndarray:
    """The sum of the log odds of each row's features, estimated on the rows of the other fold."""
    out = np.zeros(len(toxic))
    for own in (0, 1):
        others = fold[rows] != own
        odds = np.zeros(width)
        for label, sign in ((1, 1), (0, -1)):
            n = np.sum((fold != own) & (toxic == label))
            held = np.bincount(cols[others & (toxic[rows] == label)], minlength=width)
            odds += sign * np.log((held + 0.5) / (n + 1.0))
        mine = fold[rows] == own
        out += np.bincount(rows[mine], odds[cols[mine]], minlength=len(toxic))
    return out


def _cut(chance: np.ndarray, toxic: np.ndarray) -> float:
    """The midpoint between chances where the classes' hit rates differ most."""
    levels = np.unique(chance)
    cuts = np.concatenate([(levels[1:] + levels[:-1]) / 2, [1.0]])
    gain = [(chance[toxic == 1] >= c).mean() - (chance[toxic == 0] >= c).mean() for c in cuts]
    return float(cuts[int(np.argmax(gain))])


def _fit_cumulative(rows: np.ndarray, cols: np.ndarray, grade: np.ndarray, width: int, steps: int = 800,
                    rate: float = 0.05, penalty: float = 2e-5) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds of the proportional-odds model."""
    n, k = len(grade), GRADES - 1
    share = np.array([np.clip((grade <= j).mean(), 0.02, 0.98) for j in range(k)])
    start = np.maximum.accumulate(np.log(share / (1 - share)) + 1e-3 * np.arange(k))
    # parameters: weights, first threshold, logs of the gaps
    p = np.concatenate([np.zeros(width), start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    m, v = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, steps + 1):
        w, gaps = p[:width], np.exp(p[width + 1:])
        theta = p[width] + np.concatenate([[0.0], np.cumsum(gaps)])
        score = np.bincount(rows, w[cols], minlength=n)
        below = np.zeros((n, k + 2))                      # P(grade <= j - 1)
        below[:, 1:-1] = 1 / (1 + np.exp(np.clip(score[:, None] - theta[None, :], -40, 40)))
        below[:, -1] = 1.0
        here = np.arange(n)
        chance = np.maximum(below[here, grade + 1] - below[here, grade], 1e-9)
        slope = below * (1 - below)                       # derivative by the threshold
        upper, lower = slope[here, grade + 1] / chance, slope[here, grade] / chance
        by_score = (upper - lower) / n                    # of the mean loss
        by_theta = np.zeros(k)
        for j in range(k):
            by_theta[j] = (lower[grade == j + 1].sum() - upper[grade == j].sum()) / n
        g = np.concatenate([np.bincount(cols, by_score[rows], minlength=width) + penalty * w,
                            [by_theta.sum()], np.array([by_theta[j + 1:].sum() * gaps[j] for j in range(k - 1)])])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return p[:width], p[width] + np.concatenate([[0.0], np.cumsum(np.exp(p[width + 1:]))])


class _Known(dict):
    """The weighted features of tokens seen before; forgets everything when full."""

    def __init__(self, weights: dict[str, float]) -> None:
        super().__init__()
        self.weights = weights

    def __missing__(self, token: str) -> tuple[str, ...]:
        found = tuple(f for f in features(token) if f in self.weights)
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        if len(token) <= 64:
            self[token] = found
        return found


def severity(text: Column, model: Model) -> Column:
    """Struct (severity: expected grade, p_toxic: P(grade >= 1), grade: likeliest, rejected)."""
    known = _Known(model.weights)

    @F.arrow_udf("severity double, p_toxic double, grade int, rejected boolean")
    def judged(texts: pa.Array) -> pa.Array:
        make_room()
        present = [set().union(*map(known.__getitem__, set(t.lower().split()))) for t in texts.to_pylist()]
        score = np.array([sum(sorted(model.weights[f] for f in p)) for p in present])
        if model.thresholds:
            chances = model.grade_chances(score)
        else:
            chances = np.zeros((len(score), GRADES - 1))
        each = -np.diff(np.concatenate([np.ones((len(score), 1)), chances, np.zeros((len(score), 1))], axis=1), axis=1)
        return pa.StructArray.from_arrays(
            [pa.array(chances.sum(axis=1)), pa.array(chances[:, 0]), pa.array(each.argmax(axis=1).astype("int32")),
             pa.array(chances[:, 0] >= model.cut)],
            names=["severity", "p_toxic", "grade", "rejected"])

    return judged(F.coalesce(text, F.lit("")))


def judge(df: DataFrame, model: Model, text_col: str = "text") -> tuple[DataFrame, str]:
    """``df`` with a struct column of ``severity``, and that column's name."""
    name, = fresh(df.columns, "toxicity")
    return df.withColumn(name, severity(named(text_col), model)), name


def accepted(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that are not rejected, with its columns."""
    judged, name = judge(df, model, text_col)
    return judged.filter(~named(name).getField("rejected")).select(*[named(c) for c in df.columns])
