"""Personal data: candidate spans, boosted trees, calibrated thresholds.

*Formats* (leftmost, non-overlapping for each kind; failing matches dropped):
``email``, ``ip`` (four numbers up to 255), ``card`` (14 to 19 digits passing
the Luhn test) and ``phone`` (``+`` and 10 to 15 digits).  Their spans are
always redacted.

*Candidates*: high-recall generators propose further, overlapping spans:
spelt-out emails (``name (at) host``), phone numbers without ``+``, national
numbers (``123-45-6789``), account numbers (two capitals, two digits, more) and
long digit runs.

*Model*: gradient-boosted trees on features of the format (length, digits,
groups, separators, checksum) and of the context (neighbouring characters, cue words before the span).
Its labels come from planting: into each of at most ``SAMPLE_DOCS`` documents
(those whose ids hash lowest) a few made-up personal data and as many look-alikes
(order numbers, ISBNs, digests, long numbers that fail the Luhn test) are written at random places, some
after a cue word and some not, so that no feature gives the label.  Spans that
equal one of a format count as personal too, candidates that touch a labelled
span without being it as not; the documents' other candidates are left out.  Of at most ``SAMPLE_SPANS`` spans two
thirds fit the trees; on the rest the score is calibrated by a logistic curve,
the threshold is the lowest probability at which precision reaches
``PRECISION``, and the model keeps the precision and recall measured there.
Without positives or negatives the model adds nothing.

Candidates that pass and overlap no format's span are added, the most probable
first, without overlaps among themselves.

Positions are code points, ends exclusive.  Scoring is one pass without a
shuffle.  Defined results: null and empty texts have no spans; repeated rows
are treated alike; an empty table gives no rows; extra columns pass through.
"""

from __future__ import annotations

import random
import re
import zlib
from bisect import bisect_left, bisect_right
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.common import fresh, named

KINDS = ("email", "ip", "card", "phone", "spelt", "number", "account")
SAMPLE_DOCS = 4_000
SAMPLE_SPANS = 20_000
PRECISION = 0.95
PLANTED = 6

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits not followed by ".digit" cannot begin a match, nor can its tail.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
GENERATORS = (
    ("spelt", re.compile(r"[A-Za-z0-9._%+-]{1,64}\x20?[(\[]at[)\]]\x20?[A-Za-z0-9-]{1,64}"
                         r"(?:\x20?(?:\.|[(\[]dot[)\]])\x20?[A-Za-z0-9-]{1,64})+")),
    ("phone", re.compile(r"(?<![0-9+])\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-]?[0-9]{3,4}(?![0-9])")),
    ("number", re.compile(r"(?<![0-9])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9])")),
    ("account", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")),
    ("number", re.compile(r"(?<![0-9])[0-9]{7,20}(?![0-9])")),
)
CUES = ("phone", "tel", "call", "fax", "mobile", "mail", "contact", "card", "visa", "ssn", "social", "iban", "account",
        "passport", "address")
_CUE = re.compile(r"(?i)\b(?:" + "|".join(CUES) + r")")
CONTEXT = 40

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def _emails(text: str) -> list[Span]:
    spans, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at) if start < at else None
        if domain:
            end = domain.end()
            spans.append((start, end, "email"))
        at = text.find("@", max(at + 1, end))
    return spans


def formats(text: str) -> list[Span]:
    """The spans of the fixed formats, by start, then kind."""
    spans = _emails(text)
    if _HAS_DIGIT.search(text):
        spans += [(m.start(), m.end(), "ip") for m in IP.finditer(text)
                  if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                spans.append((m.start(), m.end(), "card"))
        if "+" in text:
            spans += [(m.start(), m.end(), "phone") for m in PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return in_order(spans)


_HAS_DIGIT = re.compile("[0-9]")


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def candidates(text: str) -> list[Span]:
    """What the generators propose, overlaps included; the formats' spans are among them."""
    if not _HAS_DIGIT.search(text) and "[at]" not in text and "(at)" not in text:
        return formats(text) if "@" in text else []
    found = {(m.start(), m.end()): (m.start(), m.end(), kind)
             for kind, pattern in reversed(GENERATORS) for m in pattern.finditer(text)}
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 7:
            found.setdefault(m.span(), (*m.span(), "number"))
    found |= {s[:2]: s for s in formats(text)}
    return in_order(list(found.values()))


def context(text: str, start: int) -> str:
    """What stands before a span, back to the nearest digit: cues of an earlier number don't count."""
    return re.split("[0-9]", text[max(0, start - CONTEXT):start])[-1]


def features(text: str, span: Span) -> list[float]:
    """Format and context of a candidate; neither its kind nor the formats' verdict is among them."""
    start, end, _ = span
    body = text[start:end]
    digits = _digits(body)
    before, after = text[max(0, start - CONTEXT):start], text[end:end + 1]
    groups = [g for g in re.split("[^0-9]+", body) if g]
    near = before[-1:]
    return [len(body), len(digits), len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0),
            body.count("."), body.count("-"), body.count(" "), body.count("@"), body.startswith("+"), "(" in body,
            sum(c.isalpha() for c in body), luhn(digits) if digits else 0, near.isalnum(), near.isspace() or not near,
            after.isalnum(), after.isspace() or not after, bool(_CUE.search(context(text, start))),
            max((int(g) for g in groups if len(g) <= 9), default=0) <= 255]


def _personal(rng: random.Random) -> tuple[str, str]:
    """(words before, made-up personal datum)."""
    def d(n: int) -> str:
        return "".join(rng.choices("0123456789", k=n))
    kind = rng.randrange(4)
    if kind < 2:
        body = rng.choice([f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)} {d(3)} {d(4)}", f"{d(3)}.{d(3)}.{d(4)}"])
        return rng.choice(["call", "phone:", "tel.", "contact", "my number is", "ring me at", "fax", "", "", ""]), body
    if kind == 2:
        body = rng.choice([f"{d(3)}-{d(2)}-{d(4)}", "".join(rng.choices("ABCDEGIKLNPST", k=2)) + d(2)
                           + "".join(" " + d(4) for _ in range(rng.randint(3, 5)))])
        return rng.choice(["ssn", "social security", "iban", "account", "pay to", "of", "", ""]), body
    name, host = ("".join(rng.choices("abcdeilmnorst", k=rng.randint(4, 9))) for _ in "ab")
    at, dot = rng.choice([("(at)", "(dot)"), ("[at]", "[dot]"), (" [at] ", " [dot] "), (" (at) ", ".")])
    return rng.choice(["mail", "contact", "write to", "", ""]), f"{name}{at}{host}{dot}com"


def _impersonal(rng: random.Random) -> tuple[str, str]:
    """(words before, a number that is nobody's)."""
    def d(n: int) -> str:
        return "".join(rng.choices("0123456789", k=n))
    long = d(rng.randint(14, 19))
    if luhn(long):              # one digit more makes it no card number
        long = long[:-1] + str((int(long[-1]) + 1) % 10)
    grouped = " ".join(long[i:i + 4] for i in range(0, len(long), 4))
    body = rng.choice([d(rng.randint(7, 13)), d(rng.randint(7, 13)), f"978-{d(1)}-{d(2)}-{d(6)}-{d(1)}", f"{d(4)} {d(4)}", f"20{d(2)}-{d(6)}",
                       f"{d(2)}-{d(2)}-{d(4)}-{d(2)}", f"1{d(9)}", f"{d(5)}-{d(5)}", long, long, grouped,
                       "".join(rng.choices("0123456789abcdef", (3,) * 10 + (1,) * 6, k=40))])
    return rng.choice(["order", "invoice", "lot", "no.", "part", "isbn", "page", "ticket", "version", "call number", "account page",
                       "", ""]), body


def planted(text: str) -> tuple[str, dict[tuple[int, int], int]]:
    """The text with ``PLANTED`` made-up data at places that depend on it alone, and whether each is personal."""
    rng = random.Random(zlib.crc32(text.encode()))
    places = sorted(text.find(" ", rng.randrange(len(text) + 1)) for _ in range(PLANTED))
    out, at, size, labels = [], 0, 0, {}
    for place in places:
        place = len(text) if place < 0 else max(place, at)
        label = rng.randrange(2)
        cue, body = (_personal if label else _impersonal)(rng)
        before = text[at:place] + (f" {cue} " if cue else " ")
        out += [before, body]
        size += len(before)
        labels[size, size + len(body)] = label
        size += len(body)
        at = place
    return "".join(out) + (" " if not text[at:].startswith(" ") else "") + text[at:], labels


def _label(span: tuple[int, int], labels: dict[tuple[int, int], int], known: list[tuple[int, int]]) -> int | None:
    """1 or 0 for a known span, 0 for one that touches a known span without being it (a part of it, or too long),
    None for what nobody labelled.  ``known`` are the labelled spans, which do not overlap."""
    if span in labels:
        return labels[span]
    i = bisect_left(known, (span[1], -1)) - 1           # the last one that starts before the span ends
    return 0 if i >= 0 and known[i][1] > span[0] else None


@dataclass(frozen=True)
class Trees:
    """Boosted regression trees of depth two: (feature, cut) at the root and below, four leaves."""
    bias: float
    nodes: tuple[tuple[int, float, int, float, int, float, float, float, float, float], ...]

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        for f, c, lf, lc, rf, rc, a, b, d, e in self.nodes:
            out += np.where(x[:, f] <= c, np.where(x[:, lf] <= lc, a, b), np.where(x[:, rf] <= rc, d, e))
        return out


@dataclass(frozen=True)
class Model:
    trees: Trees | None
    slope: float
    offset: float
    threshold: float
    precision: float = 0.0      # on the held-out third, at the threshold
    recall: float = 0.0

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.trees.score(x) + self.offset)))


def _split(x: np.ndarray, g: np.ndarray, h: np.ndarray, cuts: list[np.ndarray]) -> tuple[int, float]:
    """The feature and cut with the largest gain (first among equals)."""
    best, at = -1.0, (0, np.inf)
    for f, own in enumerate(cuts):
        for c in own:
            left = x[:, f] <= c
            gain = sum(g[s].sum() ** 2 / (h[s].sum() + 1.0) for s in (left, ~left))
            if gain > best + 1e-9:
                best, at = gain, (f, float(c))
    return at


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 30, rate: float = 0.3) -> Trees:
    """Logistic boosting by second-order steps."""
    cuts = [np.unique(np.quantile(col, np.linspace(0.05, 0.95, 12), method="lower")) for col in x.T]
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    bias = float(np.log(share / (1 - share)))
    score = np.full(len(y), bias)
    nodes = []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        f, c = _split(x, g, h, cuts)
        left = x[:, f] <= c
        below = [_split(x[s], g[s], h[s], cuts) if s.any() else (0, np.inf) for s in (left, ~left)]
        leaves = []
        for side, (bf, bc) in zip((left, ~left), below):
            inner = x[:, bf] <= bc
            for s in (side & inner, side & ~inner):
                value = rate * float(g[s].sum() / (h[s].sum() + 1.0))
                leaves.append(value)
                score[s] += value
        nodes.append((f, c, *below[0], *below[1], *leaves))
    return Trees(bias, tuple(nodes))


def _calibrate(score: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve through scores, by damped Newton steps."""
    b = np.array([1.0, 0.0])
    x = np.column_stack([score, np.ones(len(score))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        b = b + 0.5 * np.linalg.solve(hess, x.T @ (y - p) - 1e-2 * (b - np.array([1.0, 0.0])))
    return float(b[0]), float(b[1])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS,
        sample_spans: int = SAMPLE_SPANS) -> Model:
    kind = "array<struct<x:array<double>,y:int>>"

    @F.arrow_udf(kind)
    def examples(texts: pa.Array) -> pa.Array:
        rows = []
        for own in texts.to_pylist():
            t, labels = planted(own)
            apart = _Cover([(*s, "") for s in sorted(labels)])
            labels |= {s[:2]: 1 for s in formats(t) if apart.add(s[0], s[1])}
            known = sorted(labels)
            judged = ((s, _label(s[:2], labels, known)) for s in candidates(t))
            rows.append([{"x": [float(v) for v in features(t, s)], "y": y} for s, y in judged if y is not None])
        return pa.array(rows, pa.list_(pa.struct([("x", pa.list_(pa.float64())), ("y", pa.int32())])))

    ids = (docs.filter(named(id_col).isNotNull()).select(named(id_col).alias("doc")).distinct()
           .orderBy(F.xxhash64("doc"), "doc").limit(sample_docs))
    rows = (docs.select(named(id_col).alias("doc"), F.coalesce(named(text_col), F.lit("")).alias("text"))
            .join(F.broadcast(ids), "doc").select("doc", F.posexplode(examples("text")).alias("at", "e"))
            .select("doc", "at", "e.x", "e.y").orderBy(F.xxhash64("doc", "at"), "doc", "at", "x")
            .limit(sample_spans).collect())
    x, y = np.array([r["x"] for r in rows], dtype=float), np.array([r["y"] for r in rows], dtype=float)
    test = np.arange(len(rows)) % 3 == 2
    if len(rows) < 30 or y[test].min() == y[test].max() or y[~test].min() == y[~test].max():
        return Model(None, 1.0, 0.0, 1.0)
    trees = boost(x[~test], y[~test])
    slope, offset = _calibrate(trees.score(x[test]), y[test])
    model = Model(trees, slope, offset, 1.0)
    p = model.probability(x[test])
    fine = [c for c in np.unique(p) if y[test][p >= c].mean() >= PRECISION]
    if not fine:
        return Model(trees, slope, offset, 2.0)
    threshold = max(0.5, float(min(fine)))
    hit = p >= threshold
    return Model(trees, slope, offset, threshold, float(y[test][hit].mean()), float(hit[y[test] == 1].mean()))


def detect(text: str, model: Model) -> tuple[list[Span], list[Span]]:
    """(spans of the formats, all spans that are redacted)."""
    proposed = candidates(text)
    if not proposed:
        return [], []
    base = formats(text)
    if model.trees is None:
        return base, base
    own = {s[:2] for s in base}
    rest = [s for s in proposed if s[:2] not in own]
    if not rest:
        return base, base
    chance = model.probability(np.array([features(text, s) for s in rest], dtype=float))
    taken = _Cover(base)
    more = []
    for i in sorted(range(len(rest)), key=lambda i: (-chance[i], rest[i][0], rest[i][1])):
        if chance[i] >= model.threshold and taken.add(rest[i][0], rest[i][1]):
            more.append(rest[i])
    return base, in_order(base + more)


class _Cover:
    """Taken positions, as disjoint stretches sorted by start."""

    def __init__(self, spans: list[Span]) -> None:
        self.stretches: list[tuple[int, int]] = []
        for start, end, _ in spans:
            if self.stretches and start <= self.stretches[-1][1]:
                self.stretches[-1] = (self.stretches[-1][0], max(end, self.stretches[-1][1]))
            else:
                self.stretches.append((start, end))

    def add(self, start: int, end: int) -> bool:
        """Takes a stretch unless it touches a taken one."""
        i = bisect_left(self.stretches, (end, -1))
        if i and self.stretches[i - 1][1] > start:
            return False
        self.stretches.insert(i, (start, end))
        return True


def redact(text: str, spans: list[Span]) -> str:
    """The text with each stretch of overlapping spans replaced by its first kind in angle brackets."""
    out, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            out += [text[at:start], f"<{kind}>"]
        at = max(at, end)
    return "".join(out) + text[at:]


def written(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def found(text: Column, model: Model) -> Column:
    """Struct of counts by kind, the formats' and all spans as ``kind:start:end``, and the redacted text."""
    names = ["n_email", "n_ip", "n_card", "n_phone", "base", "spans", "redacted"]

    @F.arrow_udf("n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base string, spans string, "
                 "redacted string")
    def judged(texts: pa.Array) -> pa.Array:
        texts = texts.to_pylist()
        rows = [detect(t, model) for t in texts]
        counts = [pa.array([sum(s[2] == kind for s in base) for base, _ in rows], pa.int64()) for kind in KINDS[:4]]
        return pa.StructArray.from_arrays(
            [*counts, pa.array([written(b) for b, _ in rows], pa.string()),
             pa.array([written(a) for _, a in rows], pa.string()),
             pa.array([redact(t, a) for t, (_, a) in zip(texts, rows)], pa.string())], names=names)

    return judged(F.coalesce(text, F.lit("")))


def find(df: DataFrame, model: Model, text_col: str = "text") -> tuple[DataFrame, str]:
    """``df`` with a struct column of its texts' spans and redaction, and that column's name."""
    name, = fresh(df.columns, "pii")
    return df.withColumn(name, found(named(text_col), model)), name
