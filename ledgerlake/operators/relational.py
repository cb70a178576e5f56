"""Relational building blocks shared by the reports.

None of these moves a whole table through one task: totals are a global
aggregate (partial sums per partition, one row at the end) attached to the
detail as a scalar subquery, and text MINs only see pre-aggregated rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StringType, StructType

from ledgerlake.functions.text import CASE_INSENSITIVE


def union_positional(*frames: DataFrame) -> DataFrame:
    """UNION ALL by position; names come from the first input (SQL rule)."""
    first = frames[0]
    names = first.columns
    out = first
    for other in frames[1:]:
        if len(other.columns) != len(names):
            raise ValueError(f"UNION ALL arity {len(other.columns)} != {len(names)}")
        out = out.union(other.toDF(*names))
    return out


def _cast(c: Column | None, t: DataType) -> Column:
    if c is None:
        return F.lit("") if isinstance(t, StringType) else F.lit(None).cast(t)
    return c.cast(t)


def labelled_row(schema: StructType, values: dict[str, Column]) -> list[Column]:
    """Select list for a summary row: given values, '' for text, NULL else."""
    out = []
    for f in schema.fields:
        if f.name in values:
            out.append(values[f.name].cast(f.dataType).alias(f.name))
        else:
            out.append(_cast(None, f.dataType).alias(f.name))
    return out


def attach_scalar(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Put the columns of a one-row relation beside every row of ``df``.

    ``one_row`` must be a global aggregate (exactly one row by construction).
    Each of its columns becomes an uncorrelated scalar subquery: Spark runs
    it once (partial sums per partition, one row at the end) and hands the
    value to every task as a literal.  No join, no pairs, nothing broadcast
    but one value per column.
    """
    return df.select("*", *[one_row.select(c).scalar().alias(c) for c in one_row.columns])


def group_by_constant(df: DataFrame, name: str, label: str, *aggs: Column) -> DataFrame:
    """``SELECT 'label' AS name, aggs FROM df GROUP BY name``: no row at all
    for empty input (a plain global ``agg`` would give one)."""
    return df.groupBy(F.lit(label).alias(name)).agg(*aggs)


def sums_with_min_text(df: DataFrame, keys: list[str], sums: dict[str, Column], text: str,
                       out: str | None = None) -> DataFrame:
    """``GROUP BY keys``: the given sums and ``MIN(text)``, in one read.

    Spark's hash aggregation needs fixed-width buffers; a text MIN makes it
    fall back to sort-based aggregation of every input row.  So the rows are
    first aggregated by (keys, text) with hash aggregation (partial sums
    before the shuffle), then by keys: sums of those sums, and a text MIN
    that sees only a handful of rows per key.  NULL keys group together in
    both steps, as in SQL, and sums of exact decimal sums are the same sums."""
    lower = df.groupBy(*keys, text).agg(*[c.alias(n) for n, c in sums.items()])
    return lower.groupBy(*keys).agg(F.min(text).alias(out or text), *[F.sum(n).alias(n) for n in sums])


def collated_groups(df: DataFrame, keys: list[str], sums: dict[str, Column],
                    collation: str = CASE_INSENSITIVE) -> DataFrame:
    """``GROUP BY keys`` under a collation, each key shown in its least spelling.

    Rows are summed by spelling first (hash aggregation, partial sums before the shuffle); the collated
    grouping then sees one row for each spelling.  A plain grouping by a collated column would show
    whichever spelling a task met first."""
    spelt = df.groupBy(*[F.col(k).cast("string").alias(k) for k in keys]).agg(*[c.alias(n) for n, c in sums.items()])
    fold = spelt.select("*", *[F.collate(F.col(k), collation).alias(f"__fold_{k}") for k in keys])
    out = fold.groupBy(*[f"__fold_{k}" for k in keys]).agg(
        *[F.min(k).alias(k) for k in keys], *[F.sum(n).alias(n) for n in sums])
    return out.select(*keys, *sums)


def detail_and_total(detail: DataFrame, keys: list[str], aggs: list[Column]) -> DataFrame:
    """Detail rows and one grand-total row from a single aggregation,
    ``GROUP BY GROUPING SETS ((keys), ())`` over the detail.

    ``aggs`` re-aggregate detail columns (``F.sum("x")``, ``F.min("d")``,
    ``F.round(F.sum("x"), 2)``); over the one row of a detail group they
    return that row's value.  Computing the total as a separate aggregate of
    the detail would evaluate the detail plan twice (the two branches prune
    different columns, so Spark cannot reuse the exchange).  A NULL sentinel
    row keeps the total row present for empty input, as an aggregate without
    GROUP BY always returns one row.  Adds ``__total`` (boolean); key columns
    are NULL on the total row."""
    spark = detail.sparkSession
    sentinel = spark.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in detail.schema.fields],
                                     F.lit(False).alias("__real"))
    d = detail.withColumn("__real", F.lit(True)).unionByName(sentinel)
    g = d.groupingSets([[*keys, "__real"], []], *keys, "__real").agg(F.grouping_id().alias("__gid"), *aggs)
    return (g.where((F.col("__gid") != 0) | F.col("__real"))
            .withColumn("__total", F.col("__gid") != 0).drop("__gid", "__real"))
