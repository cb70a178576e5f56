"""Chunked scans that need no bounds from the caller.

A key column is cut into predicates which together hold every row exactly once,
whatever its distribution:

* numbers, dates and timestamps: at the quantiles of the column, so chunks hold
  about equally many rows; a value that fills chunks by itself gets an equality
  predicate, split further by a checksum of a second column where one is given;
* text: by the key's checksum (``CRC32``, which the source database and Spark
  compute alike), since the database's order of texts depends on its collation;
* NULL keys: a chunk of their own.

The predicates are plain SQL that Spark and a MySQL-protocol server both read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType, StringType, TimestampNTZType, TimestampType

from ledgerlake.sources.extract import DEFAULT_FETCHSIZE, jdbc_options, scan_query_jdbc, sql_literal

# Error of the quantile sketch: a chunk may differ by rows / ACCURACY from the others.
ACCURACY = 10_000
MAX_CHUNKS = 4096


def _name(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def checksum_predicates(column: str, parts: int, condition: str = "") -> list[str]:
    """``parts`` predicates over the rows where ``column`` is not NULL (and the condition holds), by its checksum."""
    prefix = f"{condition} AND " if condition else ""
    if parts <= 1:
        return [f"{prefix}{_name(column)} IS NOT NULL"]
    return [f"{prefix}{_name(column)} IS NOT NULL AND MOD(CRC32({_name(column)}), {parts}) = {i}" for i in range(parts)]


def range_predicates(column: str, points: Sequence, tie: str | None = None) -> list[str]:
    """Predicates between ascending ``points``; a point that comes m times is a chunk by itself (m with ``tie``)."""
    name, out = _name(column), [f"{_name(column)} IS NULL"]
    lower = ""
    for point, times in sorted(Counter(points).items()):
        at = sql_literal(point)
        out.append(f"{lower}{name} < {at}")
        if times == 1:
            lower = f"{name} >= {at} AND "
            continue
        lower = f"{name} > {at} AND "
        equal = f"{name} = {at}"
        if tie is None:
            out.append(equal)
        else:
            out += [f"{equal} AND {_name(tie)} IS NULL", *checksum_predicates(tie, times, equal)]
    out.append(lower.removesuffix(" AND ") if lower else f"{name} IS NOT NULL")
    return out


def key_predicates(keys: DataFrame, column: str, chunks: int, tie: str | None = None) -> list[str]:
    """Disjoint predicates over ``column`` that hold every row; ``keys`` may be the table, its key column, or a
    sample of it (any sample gives complete and disjoint chunks, a good one gives equal ones)."""
    if not 1 <= chunks <= MAX_CHUNKS:
        raise ValueError(f"chunks must be 1 to {MAX_CHUNKS}, not {chunks}")
    kind = keys.schema[column].dataType
    if isinstance(kind, StringType):
        return [f"{_name(column)} IS NULL", *checksum_predicates(column, chunks)]
    if not isinstance(kind, (NumericType, DateType, TimestampType, TimestampNTZType)):
        raise TypeError(f"no chunks over {column}: {kind.simpleString()}")
    shares = [i / chunks for i in range(1, chunks)]
    if not shares:
        return range_predicates(column, [])
    found = keys.agg(F.percentile_approx(F.col(column), shares, ACCURACY).alias("p")).first()["p"]
    return range_predicates(column, [p for p in found or [] if not (isinstance(p, float) and not math.isfinite(p))], tie)


def chunk_count(rows: int, chunk_rows: int = DEFAULT_FETCHSIZE) -> int:
    """How many chunks of about ``chunk_rows`` rows a table needs."""
    return min(MAX_CHUNKS, max(1, math.ceil(rows / chunk_rows)))


def scan_chunks(df: DataFrame, predicates: Sequence[str]) -> Iterator[DataFrame]:
    """The chunks one after another, each a lazy scan whose predicate reaches the source."""
    for p in predicates:
        yield df.where(F.expr(p))


def scan_chunked(df: DataFrame, column: str, chunk_rows: int = DEFAULT_FETCHSIZE, tie: str | None = None) -> DataFrame:
    """All chunks of ``df`` as one frame, numbered in ``chunk``: what a parallel read by predicates returns."""
    predicates = key_predicates(df, column, chunk_count(df.count(), chunk_rows), tie)
    numbered = reduce(lambda c, p: c.when(F.expr(p[1]), F.lit(p[0])), enumerate(predicates[1:], 1),
                      F.when(F.expr(predicates[0]), F.lit(0)))
    # one scan: the predicates are disjoint, so the first that holds is the only one
    return df.withColumn("chunk", numbered)


def sample_query(table: str, columns: Sequence[str], share: float) -> str:
    """The database's own sample of a key column: a share of the rows, drawn there, so few rows cross."""
    if not 0 < share <= 1:
        raise ValueError("share must be in (0, 1]")
    return f"SELECT {', '.join(map(_name, columns))} FROM {_name(table)} WHERE RAND(20260713) < {share}"


def jdbc_chunked(spark: SparkSession, settings: Mapping[str, str], table: str, column: str, chunks: int,
                 share: float = 0.01, tie: str | None = None, fetchsize: int = DEFAULT_FETCHSIZE) -> DataFrame:
    """A table over JDBC, one task for each chunk; the key's sample is read first over one connection."""
    keys = scan_query_jdbc(spark, settings, sample_query(table, [column], share), fetchsize=fetchsize)
    options = jdbc_options(settings, fetchsize)
    rest = {k: v for k, v in options.items() if k != "url"}
    return spark.read.jdbc(options["url"], _name(table), predicates=key_predicates(keys, column, chunks, tie),
                           properties=rest)
