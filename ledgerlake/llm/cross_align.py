"""Alignment of two tokenizers' tokens by diagonal run skipping.

Both encodings of a text are arrays of token ends (byte offsets).  At a place
where both have a token end, the index shift between the arrays is fixed; while
the arrays agree at that shift, tokens stand one to one.  Exponential probing
compares slices of doubling length at the shift and jumps over such stretches;
where a slice differs, halving finds the first difference, the irregular group
there is resolved locally by moving the array that lags until the ends meet,
and the shift is updated.

Corpus counts: how many documents hold an id pair linked.  Every document's
distinct pairs and their numbers of links are written once to the shared folder
and counted with map-side partial sums.  The statistics come back to the
documents in two ways: those of the most frequent pairs (at most ``HOT_PAIRS``,
so a bounded table) are broadcast, and the links of rarer pairs meet theirs in
a shuffled join.  A pair that a third of all documents hold is thus never a
join key, and no pair is left out.

Defined results: null and empty texts, and texts that a tokenizer does not
give back byte by byte (normalising ones change some characters), have no
tokens; other columns and repeated rows pass through, and every row counts as a
document.  Texts of any length are aligned whole.  An empty table gives no rows.
"""

from __future__ import annotations

import base64
import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.bpe import PATTERN, byte_alphabet
from ledgerlake.llm.common import fresh, keep, named, shared, stored

HOT_PAIRS = 1_000_000
# Bits of a pair's key that hold the second tokenizer's id.
ID_BITS = 24
# First slice of a probe; stretches below it are walked.
NEAR = 4
# A group of more links than this is counted by its different ids (same result, memory bounded by those).
LARGE_GROUP = 256


class ByteLevel:
    """A byte-level vocabulary file of the tokenizers library; special strings in texts are plain text.

    Where every merge makes the next id, the ids are ranks, and tiktoken gives the same tokens in a third of the
    time on one core; the constructor refuses other files.
    """

    def __init__(self, spec: str) -> None:
        import tiktoken
        parts = json.loads(spec)
        model, pre = parts["model"], parts["pre_tokenizer"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        vocab, alphabet = model["vocab"], byte_alphabet()
        if (parts.get("normalizer") or model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"]
                or not pre.get("use_regex", True)
                or [vocab[a + b] for a, b in merges] != list(range(len(alphabet), len(alphabet) + len(merges)))):
            raise ValueError("only byte-level BPE vocabularies in the order of their merges are supported")
        special = {t["content"] for t in parts["added_tokens"]}
        ranks = {bytes(alphabet[c] for c in t): i for t, i in vocab.items() if t not in special}
        self.model = tiktoken.Encoding("byte_level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.texts = [b""] * (max(vocab.values()) + 1)
        for token, ident in ranks.items():
            self.texts[ident] = token

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [self.model.encode_to_numpy(" " + t, disallowed_special=()) for t in texts]


class Pieces:
    """A sentencepiece model, which puts a blank before the text by itself."""

    def __init__(self, proto: bytes) -> None:
        from sentencepiece import SentencePieceProcessor
        self.model = SentencePieceProcessor(model_proto=proto)
        self.texts = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode()
                      for i, p in ((i, self.model.id_to_piece(i)) for i in range(self.model.get_piece_size()))]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1) if texts else []

    def joined(self, ids: list[int]) -> bytes:
        return b"".join(map(self.texts.__getitem__, ids))


def first_difference(a: list[int], b: list[int], i: int, j: int) -> int:
    """How many entries of ``a`` from ``i`` and of ``b`` from ``j`` on agree, by probing slices of doubling length.

    Both arrays end with the same entry, so a slice that reaches past an end differs unless both end there.
    """
    at, shift, width = i, j - i, NEAR
    while a[at:at + width] == b[at + shift:at + shift + width]:
        at += width
        if at >= len(a):
            return len(a) - i
        width *= 2
    while width > NEAR:           # the first difference lies in the slice just seen
        width //= 2
        if a[at:at + width] == b[at + shift:at + shift + width]:
            at += width
    while a[at] == b[at + shift]:
        at += 1
    return at - i


def alignment(ends_a: list[int], ends_b: list[int]) -> tuple[list[int], list[int]]:
    """The tokens of a, and of b, that end inside a group; all others end one.  The arrays end at the same offset."""
    inner_a: list[int] = []
    inner_b: list[int] = []
    i = j = 0
    n = len(ends_a)
    while i < n:
        x, y = ends_a[i], ends_b[j]
        if x == y:
            same = first_difference(ends_a, ends_b, i, j)
            i += same
            if i == n:
                break
            j += same
            x, y = ends_a[i], ends_b[j]
        while x != y:             # an irregular group: the end that lags moves on, and the shift with it
            if x < y:
                inner_a.append(i)
                i += 1
                x = ends_a[i]
            else:
                inner_b.append(j)
                j += 1
                y = ends_b[j]
        i += 1
        j += 1
    return inner_a, inner_b


def _places(n: int, inner: list[int]) -> np.ndarray:
    """The place after each token of ``n`` that is not among ``inner``."""
    ends = np.ones(n, dtype=bool)
    ends[inner] = False
    return np.flatnonzero(ends) + 1


class Aligner:
    """Two tokenizers with the tables that aligning them takes."""

    def __init__(self, a: ByteLevel, b: Pieces) -> None:
        self.a, self.b = a, b
        self.sizes = [np.array([len(x) for x in t.texts], dtype=np.int64) for t in (a, b)]
        # A token as it is written inside a group, and at the end of its half.
        self.written = [f"{i}{end}" for t, ends in ((a, ",|"), (b, ",;")) for end in ends for i in range(len(t.texts))]

    def align(self, texts: list[str]) -> list[tuple]:
        """(n_a, n_b, n_groups, n_links, groups, pair keys, links of each) of every text."""
        return [self._one(t, x, y) if t else (0, 0, 0, 0, "", (), ())
                for t, x, y in zip(texts, self.a.encode(texts), self.b.encode(texts))]

    def _one(self, text: str, a: np.ndarray, b: list[int]) -> tuple:
        data = (" " + text).encode()
        ids_a, ids_b = a.astype(np.int64), np.array(b, dtype=np.int64)
        ends_a, ends_b = np.cumsum(self.sizes[0][ids_a]), np.cumsum(self.sizes[1][ids_b])
        # Byte-level tokens are the text's own bytes in order, so their number tells that none is missing.
        if ends_a[-1] != len(data) or ends_b[-1:].tolist() != [len(data)] or self.b.joined(b) != data:
            return 0, 0, 0, 0, "", (), ()
        inner_a, inner_b = alignment(ends_a.tolist(), ends_b.tolist())
        to_a, to_b = _places(len(a), inner_a), _places(len(b), inner_b)
        from_a, from_b = np.concatenate([[0], to_a[:-1]]), np.concatenate([[0], to_b[:-1]])
        n_a, n_b = to_a - from_a, to_b - from_b
        groups = self._write(ids_a, ids_b, to_a, from_b, to_b, n_a, n_b)
        pairs, times = _count(*_links(ids_a, ids_b, from_a, from_b, n_a, n_b))
        return len(a), len(b), len(to_a), int((n_a * n_b).sum()), groups, pairs, times

    def _write(self, a: np.ndarray, b: np.ndarray, to_a: np.ndarray, from_b: np.ndarray, to_b: np.ndarray,
               n_a: np.ndarray, n_b: np.ndarray) -> str:
        """``a1,a2|b1;a3|b2``: the tokens in the order of their groups, first those of a."""
        size_a, size_b = len(self.a.texts), len(self.b.texts)
        last_a, last_b = a.copy(), b + 2 * size_a
        last_a[to_a - 1] += size_a
        last_b[to_b - 1] += size_b
        order = np.empty(len(a) + len(b), dtype=np.int64)
        order[np.arange(len(a)) + np.repeat(from_b, n_a)] = last_a
        order[np.arange(len(b)) + np.repeat(to_a, n_b)] = last_b
        return "".join(map(self.written.__getitem__, order.tolist()))[:-1]


def _links(a: np.ndarray, b: np.ndarray, from_a: np.ndarray, from_b: np.ndarray, n_a: np.ndarray,
           n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pair keys, and links of each, of all groups; a key may come more than once."""
    many = n_a * n_b
    large = np.flatnonzero(many > LARGE_GROUP)
    many[large] = 0
    group = np.repeat(np.arange(len(many)), many)
    within = np.arange(len(group)) - np.repeat(np.cumsum(many) - many, many)
    at_a, at_b = np.divmod(within, n_b[group])
    keys = [a[from_a[group] + at_a] << ID_BITS | b[from_b[group] + at_b]]
    links = [np.ones(len(group), dtype=np.int64)]
    for g in large:      # by different ids, each with its number of occurrences
        (xs, nx), (ys, ny) = (np.unique(x[at:at + n], return_counts=True)
                              for x, at, n in ((a, from_a[g], n_a[g]), (b, from_b[g], n_b[g])))
        keys.append((xs[:, None] << ID_BITS | ys[None, :]).ravel())
        links.append((nx[:, None] * ny[None, :]).ravel())
    return np.concatenate(keys), np.concatenate(links)


def _count(keys: np.ndarray, links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order, and the sum of each one's links."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(links[order], first)


_loaded: dict[str, Aligner] = {}


def aligner(spec_a: str, model_b: str) -> Aligner:
    """The aligner of two models (texts; the second in base 64), built once in each worker process."""
    key = f"{hash(spec_a)} {hash(model_b)}"
    keep("cross_align", _loaded.clear)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Aligner(ByteLevel(spec_a), Pieces(base64.b64decode(model_b)))
    return _loaded[key]


_OUT = pa.struct([("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()),
                  ("groups", pa.string()), ("pairs", pa.list_(pa.int64())), ("links", pa.list_(pa.int64()))])
# Texts whose tokens are Python objects at a time.
TEXTS_AT_ONCE = 64


def align(df: DataFrame, byte_level: str, pieces: str, text_col: str = "text") -> tuple[DataFrame, str]:
    """``df`` with a struct column for its text, and that column's name: n_a, n_b, n_groups, n_links, groups
    (``a1,a2|b1;a3|b2``), pairs (distinct id pairs, first id shifted by ``ID_BITS``) and links (of each pair).

    The paths are of model files; the driver reads them and their contents (of fixed size) travel with the
    function.
    """
    with open(byte_level, encoding="utf-8") as f:
        spec = f.read()
    with open(pieces, "rb") as f:
        proto = base64.b64encode(f.read()).decode()

    @F.arrow_udf("n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, links array<long>")
    def aligned(texts: pa.Array) -> pa.Array:
        model = aligner(spec, proto)
        parts = []
        for at in range(0, len(texts), TEXTS_AT_ONCE):
            rows = model.align(texts.slice(at, TEXTS_AT_ONCE).to_pylist())
            parts.append(pa.StructArray.from_arrays([pa.array([r[k] for r in rows], f.type)
                                                     for k, f in enumerate(_OUT)], fields=list(_OUT)))
        return pa.concat_arrays(parts) if parts else pa.array([], _OUT)

    name, = fresh(df.columns, "aligned")
    return df.withColumn(name, aligned(F.coalesce(named(text_col), F.lit("")))), name


@dataclass(frozen=True)
class Scored:
    """The kept columns of every row, ``n_best`` and ``count_sum``; and the corpus table
    (pair, n, best: whether n is the highest of the pair's first id)."""
    rows: DataFrame
    n_best: str
    count_sum: str
    pairs: DataFrame


def score(aligned: DataFrame, name: str, keep: dict[str, Column], hot_pairs: int = HOT_PAIRS) -> Scored:
    """Counts the linked pairs of all documents and adds them up along each document's links.

    ``keep`` names the columns of the result; they are computed while the pairs are written.
    """
    n_best, count_sum = fresh(keep, "n_best", "count_sum")
    pairs, links = "al_pairs", "al_links"
    out = named(name)
    # The text's encoding runs once; the row number written here names the row from now on.
    kept = [c.alias(f"al_keep_{k}") for k, c in enumerate(keep.values())]
    written = stored(aligned.select(*kept, out.getField("pairs").alias(pairs), out.getField("links").alias(links))
                     .withColumn("al_row", F.monotonically_increasing_id()), "alignment")

    counts = written.select(F.explode(pairs).alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))
    first = F.shiftright("pair", ID_BITS)
    counts = shared(counts.withColumn("first", first))
    highest = counts.groupBy("first").agg(F.max("n").alias("highest"))     # one row for an id of the vocabulary
    stats = counts.join(F.broadcast(highest), "first").select("pair", "n", (F.col("n") == F.col("highest")).alias("best"))

    # The least count that still leaves at most ``hot_pairs`` pairs at or above it.
    sizes = counts.groupBy(F.floor(F.log2("n")).cast("int").alias("power")).agg(F.count(F.lit(1)).alias("pairs"))
    cut, held, rest = 0, 0, False
    for power, number in sorted(((r["power"], r["pairs"]) for r in sizes.collect()), reverse=True):   # at most 64 rows
        if held + number > hot_pairs:
            cut, rest = 2 ** (power + 1), True
            break
        held += number
    hot = F.broadcast(stats.filter(F.col("n") >= cut))

    each = written.select("al_row", F.explode(F.arrays_zip(F.col(pairs).alias("pair"), F.col(links).alias("links"))).alias("l"))
    each = each.select("al_row", F.col("l.pair").alias("pair"), F.col("l.links").alias("links"))

    def summed(found: DataFrame) -> DataFrame:
        return found.groupBy("al_row").agg(F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("b"),
                                           F.sum(F.col("links") * F.col("n")).alias("s"))

    sums = summed(each.join(hot, "pair"))
    if rest:
        rare = each.join(hot.select("pair"), "pair", "left_anti").join(stats.filter(F.col("n") < cut), "pair")
        sums = sums.unionByName(summed(rare))
    sums = sums.groupBy("al_row").agg(F.sum("b").alias("b"), F.sum("s").alias("s"))
    zero = F.lit(0).cast("long")
    rows = (written.drop(pairs, links).join(sums, "al_row", "left")
            .select(*[F.col(f"al_keep_{k}").alias(c) for k, c in enumerate(keep)],
                    F.coalesce("b", zero).alias(n_best), F.coalesce("s", zero).alias(count_sum)))
    return Scored(rows, n_best, count_sum, stats)
