"""Shards in random order by a two-pass external shuffle (built-in functions only).

Pass one scatters the records uniformly into buckets that fit a task's memory,
by a seeded hash of the whole record.  Pass two shuffles every bucket by
Fisher-Yates (Spark's ``shuffle`` of the bucket's places), lays the buckets end
to end and cuts the sequence into shards whose row counts differ by at most
one.  Records cross the network once.

Copies: rows that are equal in every column have one hash, so a large group of
them would fill one bucket.  Groups above a quarter of an average bucket (or
of 1/4096 of all rows; so at most 16,384 groups) are counted first, kept as one
row and a number, and scattered copy by copy.  Which copy lands where makes no
difference, so the result depends on the records, the seed and the settings
alone.

Lost executors: the places are drawn once and written to the shared folder
before any record moves.  A task that runs again numbers the same records in
the same order and reads the same places.

Defined results: every row comes back once, null texts and ids included;
repeated rows get places of their own; texts of any length move whole.  An
empty table gives no rows and an empty folder.  Added columns take names that
clash with none of the input's.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructField, StructType

from ledgerlake.llm.common import fresh, named, shared

SEED = 20_260_713
# What one bucket holds at most, on average.
BUCKET_BYTES = 64 << 20
BUCKET_ROWS = 1 << 18
HOT_PARTS = 4096
# Copies of a hot row that one task writes out, and buckets whose offsets one task adds up.
COPY_CHUNK = 10_000
OFFSET_BLOCK = 4096


@dataclass(frozen=True)
class Sharded:
    """The rows with their shard and their place in it (under names that clash with no column)."""
    rows: DataFrame
    shard: str
    slot: str


def _row_bytes(df: DataFrame) -> Column:
    """About how many bytes a record takes."""
    parts = [F.coalesce(F.octet_length(named(f.name)), F.lit(0)) + 8
             if isinstance(f.dataType, (StringType, BinaryType)) else F.lit(8) for f in df.schema.fields]
    return reduce(lambda a, b: a + b, parts).cast("long")


def shuffled(df: DataFrame, shards: int, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES,
             bucket_rows: int = BUCKET_ROWS) -> Sharded:
    """``df`` in ``shards`` shards of random order; counts differ by at most one."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cols = df.columns
    own = [named(c) for c in cols]
    key, n, size, copy, bucket, rn, places, start, place, shard, slot = fresh(
        cols, "sh_key", "sh_n", "sh_bytes", "sh_copy", "sh_bucket", "sh_rn", "sh_places", "sh_start", "sh_place",
        "shard", "slot")

    keyed = df.withColumn(key, F.xxhash64(F.lit(seed), *own))
    # Sixteen bytes for each distinct record: all counts below come from this table.
    known = shared(keyed.withColumn(size, _row_bytes(df)).groupBy(key)
                   .agg(F.count(F.lit(1)).alias(n), F.sum(size).alias(size)))
    total = known.agg(F.coalesce(F.sum(n), F.lit(0)).alias(n), F.coalesce(F.sum(size), F.lit(0)).alias(size),
                      F.coalesce(F.max(n), F.lit(0)).alias("most")).first()
    rows = total[n]
    buckets = max(8 * partitions, -(-total[size] // bucket_bytes), -(-rows // bucket_rows))
    limit = max(1, rows // (4 * min(buckets, HOT_PARTS)))
    has_hot = total["most"] > limit

    def scattered(copy_of: Column) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed + 1), F.col(key), copy_of), F.lit(buckets))

    def each_copy(frame: DataFrame) -> DataFrame:
        """One row for each copy of rows that stand for ``n``; long runs are dealt out first."""
        chunks = frame.withColumn(copy, F.explode(F.sequence(F.lit(0).cast("long"),
                                                             F.floor((F.col(n) - 1) / COPY_CHUNK))))
        upto = F.least(F.col(n), (F.col(copy) + 1) * COPY_CHUNK) - 1
        return (chunks.repartition(key, copy)
                .withColumn(copy, F.explode(F.sequence(F.col(copy) * COPY_CHUNK, upto))))

    once = F.lit(0).cast("long")
    if has_hot:
        hot = F.broadcast(known.filter(F.col(n) > limit).select(key, n))    # at most 4 x HOT_PARTS rows
        copies = (keyed.join(hot.select(key), key, "left_semi").groupBy(*cols, key)
                  .agg(F.count(F.lit(1)).alias(n)))
        keyed = (keyed.join(hot.select(key), key, "left_anti").select(*own, key, once.alias(copy))
                 .unionByName(each_copy(copies).select(*own, key, copy)))
        held = (known.filter(F.col(n) <= limit).select(scattered(once).alias(bucket), n)
                .unionByName(each_copy(known.filter(F.col(n) > limit))
                             .select(scattered(F.col(copy)).alias(bucket), F.lit(1).cast("long").alias(n))))
    else:
        keyed = keyed.withColumn(copy, once)
        held = known.select(scattered(once).alias(bucket), n)

    drawn = shared(_drawn(held.groupBy(bucket).agg(F.sum(n).alias(n)), bucket, n, places, start, partitions, seed))

    # Second hash of the record: settles collisions of the first.
    inside = Window.partitionBy(bucket).orderBy(key, F.xxhash64(F.lit(seed + 2), *own), copy)
    numbered = keyed.withColumn(bucket, scattered(F.col(copy))).withColumn(rn, F.row_number().over(inside))
    placed = (numbered.join(drawn, bucket)
              .withColumn(place, F.col(start) + F.element_at(F.col(places), F.col(rn))))

    # The first ``more`` shards hold one row more than the others.
    least, more = divmod(rows, shards)
    at, head = F.col(place), more * (least + 1)
    early, late = at, at - head
    early_slot, late_slot = early % (least + 1), late % max(least, 1)
    early_shard, late_shard = (early - early_slot) / (least + 1), more + (late - late_slot) / max(least, 1)
    return Sharded(placed.select(
        *own, F.when(at < head, early_shard).otherwise(late_shard).cast("int").alias(shard),
        F.when(at < head, early_slot).otherwise(late_slot).cast("long").alias(slot)), shard, slot)


def _drawn(counts: DataFrame, bucket: str, n: str, places: str, start: str, partitions: int, seed: int) -> DataFrame:
    """(bucket, rows before it, its places in Fisher-Yates order) of every bucket."""
    block, before = fresh([bucket, n, places, start], "sh_block", "sh_before")
    counts = counts.withColumn(block, F.floor(F.col(bucket) / OFFSET_BLOCK))
    blocks = counts.groupBy(block).agg(F.sum(n).alias(before))
    blocks = blocks.select(block, (F.sum(before).over(Window.orderBy(block)) - F.col(before)).alias(before))
    inside = Window.partitionBy(block).orderBy(bucket)
    laid = (counts.withColumn(start, F.sum(n).over(inside) - F.col(n)).join(blocks, block)
            .select(bucket, n, (F.col(start) + F.col(before)).alias(start)))
    # Spark seeds ``shuffle`` by partition: the same buckets in the same partitions in the same order
    # give the same places each time.
    laid = laid.repartition(min(partitions, 64), bucket).sortWithinPartitions(bucket)
    return laid.select(bucket, start,
                       F.shuffle(F.sequence(F.lit(0), F.col(n).cast("int") - 1), F.lit(seed)).alias(places))


def write_shards(df: DataFrame, path: str, shards: int, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES,
                 bucket_rows: int = BUCKET_ROWS) -> Sharded:
    """Writes the shards as Parquet folders ``<path>/shard=<k>``, files in slot order; returns what was written."""
    out = shuffled(df, shards, seed, bucket_bytes, bucket_rows)
    out.rows.sortWithinPartitions(out.shard, out.slot).write.partitionBy(out.shard).parquet(path)
    schema = StructType([*df.schema.fields, StructField(out.slot, LongType()), StructField(out.shard, IntegerType())])
    return Sharded(df.sparkSession.read.schema(schema).parquet(path), out.shard, out.slot)
