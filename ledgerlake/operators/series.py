"""Running sums over long series without a single-task window.

A running sum with the SQL default frame (RANGE: rows of one order value share
the sum) is a prefix sum over the distinct order values.  It runs in two steps:

1. sums per order value (partial sums before the shuffle, so a day that holds a
   third of all rows crosses as one row per task);
2. the order values are cut into ranges at sampled splitters; each range is
   summed and run over by itself, and the sum of the ranges before it is added.

The splitters are the quantiles of a bounded uniform sample of the distinct
order values: those with the lowest hashes, so the cut is the same on every run.
They only balance the ranges; any cut gives the same sums.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.session import checkpoint_dir

# Ranges of the order column, and sampled order values for each.
RANGES = 128
SAMPLE_PER_RANGE = 32


def _sampled_splitters(values: DataFrame, order: str, ranges: int) -> list:
    """At most ``ranges - 1`` ascending splitters of the distinct values of ``order`` (no NULL, no NaN)."""
    sample = (values.select(order).where(F.col(order).isNotNull()).distinct()
              .orderBy(F.xxhash64(order)).limit(ranges * SAMPLE_PER_RANGE).collect())
    found = sorted(r[0] for r in sample if not (isinstance(r[0], float) and math.isnan(r[0])))
    step = max(1, math.ceil(len(found) / ranges))
    return found[step::step]


def _range_of(c: Column, splitters: list) -> Column:
    """Number of splitters at or below the value; NULLs come first."""
    if not splitters:
        return F.lit(0)
    marks = F.array(*[F.lit(s) for s in splitters])
    return F.coalesce(F.size(F.filter(marks, lambda s: s <= c)), F.lit(0))


def _plus(a: Column, b: Column) -> Column:
    """SUM of two sums: NULL only where both are."""
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)


def running_sums(per: DataFrame, value: str, order: str, out: str, by: Sequence[str] = (),
                 ranges: int = RANGES) -> DataFrame:
    """``per`` (one row for each ``by`` and order value) with the running SUM of ``value`` along ``order``.

    NULL order values come first and NULL values are skipped, as in SQL; a sum over NULLs alone is NULL.
    """
    by = list(by)
    # Three looks at the sums (sample, ranges, running): computed once, so the facts below are read once.
    checkpoint_dir(per.sparkSession)
    per = per.checkpoint(eager=True)
    splitters = _sampled_splitters(per, order, ranges)
    ranged = per.withColumn("__range", _range_of(F.col(order), splitters))
    inside = Window.partitionBy(*by, "__range").orderBy(F.col(order).asc_nulls_first())
    local = ranged.withColumn("__local", F.sum(value).over(inside))
    sums = ranged.groupBy(*by, "__range").agg(F.sum(value).alias("__sum"))
    if by:
        # at most RANGES rows for a key
        before = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
        offsets = sums.select(*[F.col(c).alias(f"__by_{c}") for c in by], F.col("__range").alias("__of"),
                              F.sum("__sum").over(before).alias("__before"))
        match = F.col("__range") == F.col("__of")
        for c in by:
            match = match & F.col(c).eqNullSafe(F.col(f"__by_{c}"))
        joined = local.join(offsets, match)
    else:
        # at most RANGES sums, as one array behind a scalar subquery
        entries = F.collect_list(F.struct("__range", "__sum"))
        table = sums.agg(entries.alias("__sums"))
        earlier = F.filter("__sums", lambda s: (s["__range"] < F.col("__range")) & s["__sum"].isNotNull())
        kind = sums.schema["__sum"].dataType
        total = F.aggregate(earlier, F.lit(0).cast(kind), lambda a, s: (a + s["__sum"]).cast(kind))
        joined = (local.withColumn("__sums", table.scalar())
                  .withColumn("__before", F.when(F.size(earlier) > 0, total)))
    return joined.select(*[F.col(c) for c in per.columns], _plus(F.col("__before"), F.col("__local")).alias(out))


def running_total(df: DataFrame, value: str, order: str, out: str, by: Sequence[str] = (),
                  ranges: int = RANGES) -> DataFrame:
    """Every row of ``df`` with the running SUM of ``value`` along ``order`` (RANGE frame) within ``by``.

    The sums meet the rows again in a join on ``by`` and ``order``: Spark broadcasts them where they are small
    (days, months) and splits hot days otherwise.
    """
    by = list(by)
    per = df.groupBy(*by, order).agg(F.sum(value).alias("__value"))
    run = running_sums(per, "__value", order, out, by, ranges)
    keys = [*by, order]
    sums = run.select(*[F.col(c).alias(f"__key_{c}") for c in keys], out)
    match = F.lit(True)
    for c in keys:
        match = match & F.col(c).eqNullSafe(F.col(f"__key_{c}"))
    return df.join(sums, match).select(*[df[c] for c in df.columns], out)
