"""Near-duplicates by SimHash, linked through Golay-code fuzzy hashing.

A document's fingerprint takes the XXH64 (seed 42) of every k-word shingle,
repeats included; a bit is set when it is set in over half of the hashes.  Two
fingerprints link when they differ in at most two bits, and a class is what
links reach.

Candidates.  The 64 bits are cut into segments of 22, 21 and 21 bits.  Two
differing bits leave at least one of the three segments without an error
(pigeonhole), and the next segment with at most two.  A segment, zero-padded to
23 bits, is decoded by the perfect binary Golay code [23,12,7]: a word and
each of its 23 one-bit neighbours are decoded, which gives the indices of the
nearby codewords, one or six of them.  Two words at distance two or less have
a word between them within distance one of both, so they share an index.
Hence every pair within two bits shares a key (exact segment, codeword index
of the next); joined pairs are verified by their exact distance.

Skew.  Equal fingerprints are merged first, so copies cost nothing after the
hashing.  Keys of one fingerprint are dropped.  Where a key holds more
than ``bucket`` different fingerprints no pairs are formed: those fingerprints
are linked through their 65 words at distance at most one instead.  Two
fingerprints are within two bits exactly when they share such a word, so this
is exact, needs no verification, and costs a fixed factor for each
fingerprint however large the bucket is.

Defined results: null, empty and blank texts have fingerprint zero and are
linked like any other; fewer than k words give one shingle of all words; null
ids take part and get the smallest non-null id of their class (null when
there is none).  An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.common import fresh, named, row_key, shared
from ledgerlake.llm.components import components

SEED = 42
MAX_BITS = 2
SEGMENTS = ((0, 22), (22, 21), (43, 21))   # (shift, width)
BUCKET = 32
_CHUNK = 1 << 16


def fingerprint(text: bytes | None, k: int = 3) -> int:
    """The 64-bit SimHash of a UTF-8 text (words split at ASCII white space, A-Z lower-cased)."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    k = min(k, len(words))
    n = len(words) - k + 1
    shingles = map(b" ".join, zip(*(words[i:] for i in range(k)))) if k > 1 else iter(words)
    hashes = map(xxhash.xxh64_intdigest, shingles, repeat(SEED))
    counts = np.zeros(64, dtype=np.int64)
    for start in range(0, n, _CHUNK):
        part = np.fromiter(hashes, dtype="<u8", count=min(_CHUNK, n - start))
        bits = np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64)
        counts += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, text_col: str = "text", k: int = 3):
    """Column: the fingerprint as a signed 64-bit integer."""
    @F.arrow_udf("long")
    def simhash(texts: pa.Array) -> pa.Array:
        out = np.fromiter((fingerprint(t, k) for t in texts.cast(pa.binary()).to_pylist()), dtype="<u8",
                          count=len(texts))
        return pa.array(out.view("<i8"), type=pa.int64())

    return simhash(F.coalesce(named(text_col), F.lit("")))


class Golay:
    """The perfect binary Golay code [23,12,7] with complete table decoding."""

    GENERATOR = 0b110001110101   # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1

    def __init__(self) -> None:
        self.low = np.array([self._mod(x) for x in range(1 << 12)], dtype=np.int64)
        self.high = np.array([self._mod(x << 12) for x in range(1 << 11)], dtype=np.int64)
        self.error = np.zeros(1 << 11, dtype=np.int64)
        for weight in (1, 2, 3):
            for places in combinations(range(23), weight):
                e = sum(1 << p for p in places)
                self.error[self._mod(e)] = e

    def _mod(self, x: int) -> int:
        for bit in range(22, 10, -1):
            if x >> bit & 1:
                x ^= self.GENERATOR << (bit - 11)
        return x

    def index(self, words: np.ndarray) -> np.ndarray:
        """The 12-bit index of the codeword nearest to each 23-bit word."""
        syndrome = self.low[words & 0xFFF] ^ self.high[words >> 12]
        return (words ^ self.error[syndrome]) >> 11

    def nearby(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, index) for the codewords decoded from each word and its 23 one-bit neighbours."""
        flips = np.concatenate([[0], 1 << np.arange(23)]).astype(np.int64)
        found = np.sort(self.index(words[:, None] ^ flips), axis=1)
        first = np.ones(found.shape, dtype=bool)
        first[:, 1:] = found[:, 1:] != found[:, :-1]
        rows, at = np.nonzero(first)
        return rows, found[rows, at]


_golay: list[Golay] = []


def golay_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): several keys for each unsigned fingerprint; pairs within two bits share one."""
    if not _golay:
        _golay.append(Golay())
    segments = [((prints >> np.uint64(s)) & np.uint64((1 << w) - 1)).astype(np.int64) for s, w in SEGMENTS]
    rows, keys = [], []
    for i, exact in enumerate(segments):
        at, index = _golay[0].nearby(segments[(i + 1) % len(segments)])
        rows.append(at)
        keys.append((i << 40) | (exact[at] << 12) | index)
    return np.concatenate(rows), np.concatenate(keys)


def _key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = batch.column(0).to_numpy(zero_copy_only=False)
        rows, keys = golay_keys(prints.view("<u8"))
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(prints[rows])], names=["key", "fp"])


def links(prints: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) that connect all distinct fingerprints ``fp`` within two bits of each other.

    Light keys give verified pairs, heavy ones star edges through the words between.
    """
    keys = prints.select("fp").mapInArrow(_key_rows, "key long, fp long")
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared_keys = shared(keys.join(sizes, "key"))
    light = shared_keys.filter(F.col("n") <= bucket).select("key", "fp")
    other = light.select("key", F.col("fp").alias("gp"))
    pairs = light.join(other, (light["key"] == other["key"]) & (F.col("fp") < F.col("gp")) & (
        F.bit_count(F.col("fp").bitwiseXOR(F.col("gp"))) <= MAX_BITS)).select(
            F.col("fp").alias("a"), F.col("gp").alias("b"))
    heavy = shared_keys.filter(F.col("n") > bucket).select("fp").distinct()
    ball = heavy.select("fp", F.explode(F.expr(
        "concat(array(fp), transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i)))")).alias("word"))
    centre = ball.groupBy("word").agg(F.min("fp").alias("b"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    stars = ball.join(centre, "word").select(F.col("fp").alias("a"), "b").filter("a <> b")
    return pairs.unionByName(stars).distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3,
                    bucket: int = BUCKET) -> DataFrame:
    """(id, row_key, fp, root, component_id) for every row of ``df``.

    ``root`` is the smallest fingerprint of the class and names it;
    ``component_id`` is the smallest id reachable, which different classes
    share when ids repeat or are null.
    """
    docs = shared(df.select(named(id_col).alias("id"), row_key(df, id_col, text_col).alias("row_key"),
                            fingerprints(df, text_col, k).alias("fp")))
    prints = shared(docs.groupBy("fp").agg(F.min("id").alias("id")))
    roots = components(links(prints, bucket))
    classes = (prints.join(roots, prints["fp"] == roots["node"], "left")
               .select("fp", "id", F.coalesce("root", "fp").alias("root")))
    least = classes.groupBy("root").agg(F.min("id").alias("component_id"))
    classes = classes.join(least, "root").select("fp", "root", "component_id")
    return docs.join(classes, "fp").select("id", "row_key", "fp", "root", "component_id")


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3) -> DataFrame:
    """The rows of ``df`` without near-duplicates: each class keeps the row of its smallest id (nulls last).

    Of rows that repeat that id, one stays (smallest digest of id and text,
    then smallest hash of the whole row).
    """
    cols = df.columns
    row, best = fresh(cols, "sd_row", "sd_best")
    # Aggregates, so that a hot class or a hot row is reduced before the exchange.
    stays = (near_duplicates(df, id_col, text_col, k).groupBy("root")
             .agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row_key", "fp")).alias("stay"))
             .select(F.col("stay.id").alias("stay_id"), F.col("stay.row_key").alias("stay_key")))
    keyed = df.withColumn(row, row_key(df, id_col, text_col))
    joined = keyed.join(stays, F.col(row).eqNullSafe(F.col("stay_key"))
                        & named(id_col).eqNullSafe(F.col("stay_id")), "left_semi")
    whole = [named(c) for c in cols]
    return (joined.groupBy(named(id_col).alias("stay_id"), F.col(row))
            .agg(F.min_by(F.struct(*whole), F.xxhash64(*whole)).alias(best))
            .select(*[F.col(best).getField(c).alias(c) for c in cols]))
