"""Table integrity for the customer model.

Spark does not enforce keys or constraints, so they are checks that return
the violating rows (empty = valid), plus the load-time behaviour of column
defaults, update stamps and generated keys.  All are distributed: no check
collects a table, and key generation never funnels rows through one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import (
    DoubleType,
    IntegerType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)

# Fixed schemas of the customer model (VARCHAR(150) -> string, checked by
# ``check_columns``; DATETIME/TIMESTAMP -> timestamp without zone).
TEXT_LIMIT = 150
_TS = TimestampNTZType()
CUSTOMER_MODEL: dict[str, StructType] = {
    "customers": StructType([
        StructField("customer_id", IntegerType(), False), StructField("customer_name", StringType()),
        StructField("phone_number", StringType()), StructField("email_address", StringType()),
        StructField("country", StringType()), StructField("created_at", _TS), StructField("updated_at", _TS)]),
    "products": StructType([
        StructField("product_sku", IntegerType(), False), StructField("product_name", StringType()),
        StructField("unit_price", DoubleType()), StructField("created_at", _TS), StructField("updated_at", _TS)]),
    "channels": StructType([
        StructField("channel_id", IntegerType(), False), StructField("channel_name", StringType()),
        StructField("created_at", _TS), StructField("updated_at", _TS)]),
    "purchase_history": StructType([
        StructField("customer_id", IntegerType()), StructField("product_sku", IntegerType()),
        StructField("channel_id", IntegerType()), StructField("quantity", IntegerType()),
        StructField("discount", DoubleType()), StructField("order_date", _TS, False),
        StructField("created_at", _TS), StructField("updated_at", _TS)]),
    "visit_history": StructType([
        StructField("customer_id", IntegerType()), StructField("channel_id", IntegerType()),
        StructField("visit_timestamp", _TS, False), StructField("bounce_timestamp", _TS),
        StructField("created_at", _TS), StructField("updated_at", _TS)]),
}
PRIMARY_KEYS = {"customers": ["customer_id"], "products": ["product_sku"], "channels": ["channel_id"]}
FOREIGN_KEYS = {  # child table: [(column, parent table, parent column)]
    "purchase_history": [("channel_id", "channels", "channel_id"), ("customer_id", "customers", "customer_id"),
                         ("product_sku", "products", "product_sku")],
    "visit_history": [("channel_id", "channels", "channel_id"), ("customer_id", "customers", "customer_id")],
}
DEFAULTS = {"purchase_history": {"discount": 0.0}}
STAMPS = ("created_at", "updated_at")


def apply_schema(df: DataFrame, schema: StructType) -> DataFrame:
    """The table's declared columns and types, in order; a declared
    column the input lacks is NULL (stamps are filled by ``apply_defaults``)."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
                       for f in schema.fields])


def check_pk(df: DataFrame, key: list[str]) -> DataFrame:
    """Key values that occur more than once or contain NULL, with
    their row count.  A hash aggregate with partial counts: a hot key is
    pre-counted per partition, never gathered row by row."""
    g = df.groupBy(*key).agg(F.count(F.lit(1)).alias("rows"))
    null_key = F.lit(False)
    for k in key:
        null_key = null_key | F.col(k).isNull()
    return g.where((F.col("rows") > 1) | null_key)


def check_fk(child: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Child rows whose non-NULL reference has no parent row."""
    p = parent.select(F.col(parent_column).alias(column)).where(F.col(column).isNotNull())
    return child.where(F.col(column).isNotNull()).join(p, column, "left_anti")


def check_columns(df: DataFrame, not_null: list[str], text_limit: int = TEXT_LIMIT) -> DataFrame:
    """Per column, NULLs where NOT NULL is declared and text longer
    than the limit; one scan, one row per column."""
    aggs, names = [], []
    for f in df.schema.fields:
        c = F.col(f.name)
        nulls = F.count_if(c.isNull()) if f.name in not_null else F.lit(0).cast("bigint")
        long_ = F.count_if(F.length(c) > text_limit) if isinstance(f.dataType, StringType) else F.lit(0).cast("bigint")
        aggs += [nulls.alias(f"n_{len(names)}"), long_.alias(f"l_{len(names)}")]
        names.append(f.name)
    one = df.agg(*aggs)
    stack = ", ".join(f"'{n}', n_{i}, l_{i}" for i, n in enumerate(names))
    return one.selectExpr(f"stack({len(names)}, {stack}) AS (column_name, null_violations, length_violations)")


def apply_defaults(df: DataFrame, defaults: dict[str, object], load_ts: Column,
                   stamps=STAMPS) -> DataFrame:
    """S17 (insert): NULL columns take their declared default; missing or
    NULL stamps take the load time."""
    out = df
    for c, v in defaults.items():
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(v)))
    for s in stamps:
        out = out.withColumn(s, F.coalesce(F.col(s), load_ts) if s in out.columns else load_ts)
    return out


def upsert_stamp(current: DataFrame, incoming: DataFrame, key: list[str], load_ts: Column,
                 stamps=STAMPS, latest_by: Sequence[str] = ()) -> DataFrame:
    """S17 (update): merge a batch into the table by key.  New keys are
    inserted with both stamps = load time; existing keys take the incoming
    values, and ``updated_at`` moves only where a value really changed
    (NULL-safe comparison).  Keys absent from the batch are kept.

    Columns that the batch does not mention keep their values (NULL on new
    keys); columns that only the batch has are added, except those that only
    order it (``latest_by``).  Of batch rows that
    repeat a key, the one with the greatest ``latest_by`` counts, ties and a
    missing ``latest_by`` by the greatest values.  Keys compare NULL-safe, and
    every row of the table stays one row.

    A full outer join would do the same in one step, but adaptive execution
    does not split its hot keys; so updates are a left join (split on the
    table's side) and inserts an anti-join against the table's distinct keys.
    Repeated batch keys are merged before the shuffle, task by task."""
    created, updated = stamps
    ordering = [c for c in latest_by if c not in current.columns]
    values = [c for c in incoming.columns if c not in key and c not in stamps and c not in ordering]
    kept = [c for c in current.columns if c not in key and c not in stamps and c not in values]
    fields = list(dict.fromkeys([*latest_by, *values]))
    rank = F.struct(*[F.col(c) for c in fields]) if fields else F.struct(F.lit(1))
    batch = (incoming.groupBy(*key).agg(F.max(rank).alias("__b"), F.lit(True).alias("__in_batch"))
             .select(*[F.col(c).alias(f"__key_{c}") for c in key], "__b", "__in_batch"))
    batch = batch.select(*[f"__key_{c}" for c in key], "__in_batch",
                         *[F.col("__b").getField(c).alias(f"__new_{c}") for c in values])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__key_{c}")) for c in key])
    in_batch = F.col("__in_batch").isNotNull()
    changed = F.lit(False)
    for c in values:
        old = F.col(c) if c in current.columns else F.lit(None)
        changed = changed | ~F.col(f"__new_{c}").eqNullSafe(old)

    # Updates: a left join, whose table side adaptive execution splits where a key is hot.
    cols = [F.col(c) for c in key]
    for c in values:
        new = F.col(f"__new_{c}")
        cols.append((F.when(in_batch, new).otherwise(F.col(c)) if c in current.columns else new).alias(c))
    cols += [F.col(c) for c in kept]
    cols.append(F.col(created))
    cols.append(F.when(in_batch & changed, load_ts).otherwise(F.col(updated)).alias(updated))
    updates = current.join(batch, same, "left").select(*cols)

    # Inserts: batch keys that the table lacks; of the table only its distinct keys take part.
    known = current.select(*key).distinct()
    fresh = batch.join(known, same, "left_anti")
    types = {f.name: f.dataType for f in current.schema}
    inserts = fresh.select(*[F.col(f"__key_{c}").alias(c) for c in key], *[F.col(f"__new_{c}").alias(c) for c in values],
                           *[F.lit(None).cast(types[c]).alias(c) for c in kept],
                           load_ts.alias(created), load_ts.alias(updated))
    return updates.unionByName(inserts)


def assign_keys(df: DataFrame, natural_key: list[str], key: str, existing: DataFrame | None = None,
                partitions: int | None = None) -> DataFrame:
    """Dense integer keys in natural-key order, starting after the
    largest key of ``existing`` (or at 1), as AUTO_INCREMENT would.

    Range-partition on the natural key, sort within partitions, and number
    rows locally; each partition's offset is the running count of the
    partitions before it (one small row per partition, broadcast).  The
    numbered frame is checkpointed to the shared checkpoint folder first, so
    the counts and the rows are the same data even if an executor is lost
    and tasks are re-run.  No global window, no single task.  Rows of equal
    natural keys are numbered by a digest of the row.  The checkpoint lives as
    long as the result may be read; ``spark.cleaner.referenceTracking.
    cleanCheckpoints`` has Spark remove it afterwards.
    """
    from ledgerlake.session import checkpoint_dir

    spark = df.sparkSession
    checkpoint_dir(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the digest of the whole row lets a natural key that repeats often split
    tie = F.xxhash64(*df.columns)
    ranged = (df.repartitionByRange(n, *natural_key, tie).sortWithinPartitions(*natural_key, tie)
              .withColumn("__pid", F.spark_partition_id())
              .withColumn("__mid", F.monotonically_increasing_id()))
    ranged = ranged.checkpoint(eager=True)
    # local row number: the id's low 33 bits count rows within the partition
    local = (F.col("__mid") - F.shiftleft(F.col("__pid").cast("bigint"), 33))
    counts = ranged.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n"))
    offsets = counts.select("__pid", (F.sum("__n").over(Window.orderBy("__pid")) - F.col("__n")).alias("__off"))
    out = ranged.join(F.broadcast(offsets), "__pid", "inner")
    if existing is not None:
        from ledgerlake.operators.relational import attach_scalar
        top = existing.agg(F.coalesce(F.max(key), F.lit(0)).cast("bigint").alias("__start"))
        out = attach_scalar(out, top)
        start_c = F.col("__start") + F.lit(1)
    else:
        start_c = F.lit(1)
    return out.select((start_c + F.col("__off") + local).cast("bigint").alias(key),
                      *[c for c in df.columns if c != key])
