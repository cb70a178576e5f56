"""Benchmark decontamination by SimHash over item-sized windows (built-in functions only).

Texts are lower-cased and cut into words (runs of letters and digits), words
into five-word shingles (fewer words: one shingle of all of them, so an item of
one to four words only matches a document that consists of it alone).  An item
leaks into a document when some window of the document with as many shingles
as the item has a weighted-shingle (multiset Jaccard) similarity of 0.8 or
more with it.

1. *Windows.*  A window that similar shares at least ``0.8 / 1.8`` of both
   sizes with the item, so that many of its places hold a shingle of an item of
   that size.  Windows are laid at every start where they do, found from the
   sorted list of such places: no similar window is missed, wherever words were
   inserted, deleted or moved, and prose that shares a phrase lays none.
2. *Fingerprints.*  Windows and items get 64-bit SimHashes of their shingle
   hashes, every occurrence weighing one.
3. *Multi-index.*  Fingerprints are cut into four blocks of 16 bits; two within
   ``radius`` bits differ in at most ``radius / 4`` bits of at least one
   (pigeonhole).  Items are entered under all block values that near (697 of
   65,536 for the default radius), windows look up their own; pairs within the
   radius are candidates.  Only numbers and fingerprints travel here.
4. *Verification.*  Candidates fetch their shingles and are compared by the
   exact weighted similarity of the multisets.

Skew.  The benchmark's shingles are broadcast only when counted to fit
``BROADCAST_SHINGLES``, and joined by Spark's own choice beyond.  A passage in
a third of all documents gives each of them its own few windows; nothing is
grouped by passage or item.

Defined results: null and empty texts have no shingles and never leak, empty
items never match; several rows of one id are judged by their own texts; a
null id is judged like any other.  An empty benchmark leaves every document
clean, an empty table gives no rows; extra columns pass through.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.common import fresh, named, row_key, shared

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 15
# Benchmark shingles (16 bytes each) up to which they are broadcast.
BROADCAST_SHINGLES = 1_000_000


def shingles(df: DataFrame, text: Column, out: str) -> DataFrame:
    """``df`` with the array of the text's shingle hashes, in text order, repeats included."""
    words, = fresh(df.columns, "word_hashes")
    df = df.withColumn(words, F.transform(
        F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}\p{N}]+"), lambda w: w != ""),
        lambda w: F.xxhash64(w)))
    w = named(words)
    at = [lambda i, k=k: F.get(w, i + k) for k in range(1, SHINGLE)]
    return df.withColumn(out, F.when(F.size(w) >= SHINGLE, F.transform(
        F.slice(w, 1, F.greatest(F.size(w) - (SHINGLE - 1), F.lit(1))),
        lambda x, i: F.xxhash64(x, *[f(i) for f in at])))
        .when(F.size(w) > 0, F.array(F.xxhash64(w)))
        .otherwise(F.expr("array()").cast("array<bigint>"))).drop(words)


def simhash(hashes: str) -> Column:
    """The SimHash of a column of hashes: a bit is set when it is in over half of them."""
    return F.expr(f"""aggregate(sequence(0, 63), 0L, (bits, b) -> CASE
        WHEN 2 * aggregate({hashes}, 0, (n, h) -> n + CAST(shiftright(h, b) & 1 AS INT)) > size({hashes})
        THEN bits | shiftleft(1L, b) ELSE bits END)""")


BLOCKS, WIDTH = 4, 16


def blocks(fingerprint: str) -> Column:
    """(block, bits) of the blocks of a fingerprint."""
    return F.array(*[F.struct(F.lit(i).alias("block"), F.expr(
        f"CAST(shiftrightunsigned({fingerprint}, {i * WIDTH}) & {(1 << WIDTH) - 1}L AS INT)").alias("bits"))
        for i in range(BLOCKS)])


def near_blocks(fingerprint: str, radius: int) -> Column:
    """``blocks`` with every value within the errors that a block of a pair within ``radius`` may have."""
    masks = [sum(1 << k for k in places) for errors in range(radius // BLOCKS + 1)
             for places in combinations(range(WIDTH), errors)]
    return F.flatten(F.transform(blocks(fingerprint), lambda b: F.transform(
        F.lit(masks), lambda x: F.struct(b["block"].alias("block"), b["bits"].bitwiseXOR(x).alias("bits")))))


def first_agreement(a: str, b: str, radius: int) -> Column:
    """The number of the first block on which two fingerprints differ as little as the pigeonhole asks (-1: none)."""
    near = [f"bit_count(shiftrightunsigned({a} ^ {b}, {i * WIDTH}) & {(1 << WIDTH) - 1}L) <= {radius // BLOCKS}"
            for i in range(BLOCKS)]
    return F.expr(f"array_position(array({', '.join(near)}), true) - 1")


def starts(places: str, n: str, m: str, threshold: float) -> Column:
    """The starts of windows of ``m`` shingles (all ``n`` of a shorter text) of which enough are among the sorted
    ``places``."""
    size = f"least({m}, {n})"
    need = f"greatest(1, CAST(ceil({threshold} * ({size} + {m}) / {1 + threshold} - 1e-9) AS INT))"
    return F.expr(f"""CASE WHEN size({places}) >= {need} THEN array_distinct(flatten(transform(
        sequence(0, size({places}) - {need}), k -> CASE WHEN {places}[k + {need} - 1] - {places}[k] < {size}
        THEN sequence(greatest(0, {places}[k + {need} - 1] - {size} + 1), least({places}[k], {n} - {size}))
        ELSE CAST(array() AS ARRAY<INT>) END))) ELSE CAST(array() AS ARRAY<INT>) END""")


def similarity(a: str, b: str) -> Column:
    """Weighted Jaccard of two shingle multisets given as arrays."""
    shared_weight = F.expr(f"""aggregate(array_distinct({a}), 0, (n, x) -> n + least(
        size(filter({a}, y -> y = x)), size(filter({b}, y -> y = x))))""")
    return shared_weight / (F.size(a) + F.size(b) - shared_weight)


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          item_col: str = "item_id", item_text_col: str = "text", threshold: float = SIMILARITY,
          radius: int = RADIUS) -> DataFrame:
    """(id, row_key, item_id, start, similarity): the windows of documents that leak an item.

    ``start`` is the window's first shingle; a passage found at neighbouring
    starts gives a row for each.
    """
    items = shingles(items.select(named(item_col).alias("item_id"), named(item_text_col).alias("t")),
                     F.col("t"), "item_shingles").filter(F.size("item_shingles") > 0)
    items = shared(items.select(F.monotonically_increasing_id().alias("item"), "item_id", "item_shingles",
                                F.size("item_shingles").alias("m"), simhash("item_shingles").alias("item_fp")))
    held = shared(windows(docs, items, id_col, text_col, threshold)
                  .select(F.monotonically_increasing_id().alias("window"), "id", "row_key", "start", "m", "w",
                          simhash("w").alias("fp")))
    entry = items.select("item", "m", "item_fp", F.inline(near_blocks("item_fp", radius)))
    pairs = (held.select("window", "m", "fp", F.inline(blocks("fp"))).join(entry, ["m", "block", "bits"])
             .filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius)
             # of the blocks on which a pair agrees, the first one reports it
             .filter(F.col("block") == first_agreement("fp", "item_fp", radius)).select("window", "item"))
    meets = (pairs.join(held.select("window", "id", "row_key", "start", "w"), "window")
             .join(items.select("item", "item_id", "item_shingles"), "item")
             .withColumn("similarity", similarity("w", "item_shingles"))
             .filter(F.col("similarity") >= threshold))
    return meets.select("id", "row_key", "item_id", "start", "similarity").distinct()


def windows(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            threshold: float = SIMILARITY) -> DataFrame:
    """(id, row_key, m, start, w) of every window that may be similar to one of the ``items`` (item_shingles, m)."""
    index = items.select("m", F.explode("item_shingles").alias("shingle")).distinct()
    if index.count() <= BROADCAST_SHINGLES:
        index = F.broadcast(index)
    texts = docs.select(named(id_col).alias("id"), row_key(docs, id_col, text_col).alias("row_key"),
                        named(text_col).alias("t"))
    found = shingles(texts, F.col("t"), "s").select("id", "row_key", "s")
    # The outer form: for the inner one the optimizer would add a filter on the
    # array and copy the words' expression into the shingles' lambda.
    known = (found.select("id", "row_key", F.size("s").alias("n"), F.posexplode_outer("s").alias("pos", "shingle"))
             .join(index, "shingle").groupBy("id", "row_key", "m")
             .agg(F.sort_array(F.collect_set("pos")).alias("places"), F.max("n").alias("n")))
    laid = known.select("id", "row_key", "m", starts("places", "n", "m", threshold).alias("starts"))
    places = shared(laid.filter(F.size("starts") > 0).groupBy("id", "row_key")
                    .agg(F.collect_list(F.struct("m", "starts")).alias("places")))

    # The windows' shingles come from a second look at the documents that have any.
    texts = texts.withColumnsRenamed({"id": "own_id", "row_key": "own_key"})
    held = texts.join(places, F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_key") == F.col("row_key")))
    held = shingles(held, F.col("t"), "s").select("id", "row_key", "s", F.inline("places"))
    held = held.select("id", "row_key", "s", "m", F.explode("starts").alias("start"))
    return held.select("id", "row_key", "m", "start", F.expr("slice(s, start + 1, m)").alias("w"))


def judge(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, row_key, n_items, item_id, similarity) for each document row that leaks: its most similar item (ties: the smallest)."""
    best = F.min(F.struct((-F.col("similarity")).alias("minus"), F.col("item_id").alias("item_id")))
    return (leaks(docs, items, id_col, text_col, **options).groupBy("id", "row_key")
            .agg(F.countDistinct("item_id").alias("n_items"), best.alias("best"))
            .select("id", "row_key", "n_items", F.col("best.item_id").alias("item_id"),
                    (-F.col("best.minus")).alias("similarity")))


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` into which no item leaks, with its columns."""
    key, = fresh(docs.columns, "dc_row")
    found = judge(docs, items, id_col, text_col, **options).select(
        F.col("id").alias("leak_id"), F.col("row_key").alias("leak_key"))
    keyed = docs.withColumn(key, row_key(docs, id_col, text_col))
    return (keyed.join(found, named(id_col).eqNullSafe(F.col("leak_id")) & (F.col(key) == F.col("leak_key")),
                       "left_anti").select(*[named(c) for c in docs.columns]))
