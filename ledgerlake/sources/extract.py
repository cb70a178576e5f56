"""Extract ERP tables to Parquet.

The source is a database reached through Spark's JDBC source (parallel reads
by column ranges or predicates) or, for tests and re-runs, a folder of Parquet
tables.  Writes go through Spark's committer: a failed job leaves no partial
output, and a re-run of one day replaces only that day's partition.
"""

from __future__ import annotations

import datetime as dt
import decimal
import logging
import re
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerlake.functions.erp import safe_table_name
from ledgerlake.functions.text import CASE_INSENSITIVE, collated
from ledgerlake.session import checkpoint_dir

log = logging.getLogger(__name__)

DEFAULT_FETCHSIZE = 50_000      # rows per round trip, as the source's chunk size
DEFAULT_COMPRESSION = "snappy"


# --------------------------------------------------------------------------
# Connection options
# --------------------------------------------------------------------------

def jdbc_options(settings: Mapping[str, str], fetchsize: int = DEFAULT_FETCHSIZE) -> dict[str, str]:
    """Spark JDBC options for a MySQL-protocol server.

    ``settings`` needs ``host``, ``database``, ``user`` and ``password``;
    ``port`` and ``driver`` are optional.  Spark picks the SQL dialect by the
    URL: only ``jdbc:mysql:`` quotes names with backticks (any other URL gets
    double quotes, which these servers read as text).  The MariaDB connector
    accepts that URL when it carries ``permitMysqlScheme``.  Credentials are
    options, never part of the URL."""
    missing = [k for k in ("host", "database", "user", "password") if not settings.get(k)]
    if missing:
        raise ValueError(f"connection settings lack {', '.join(missing)}")
    return {
        "url": f"jdbc:mysql://{settings['host']}:{settings.get('port', '3306')}/{settings['database']}"
               "?permitMysqlScheme",
        "driver": settings.get("driver", "org.mariadb.jdbc.Driver"),
        "user": settings["user"], "password": settings["password"], "fetchsize": str(fetchsize),
    }


@dataclass(frozen=True)
class RangeSplit:
    """A parallel read: ``tasks`` ranges of a number, date or timestamp column."""
    column: str
    lower: int | dt.date | dt.datetime
    upper: int | dt.date | dt.datetime
    tasks: int

    def options(self) -> dict[str, str]:
        return {"partitionColumn": self.column, "lowerBound": str(self.lower), "upperBound": str(self.upper),
                "numPartitions": str(self.tasks)}


def day_predicates(column: str, days: Sequence[dt.date]) -> list[str]:
    """One predicate for each stretch between consecutive days, open at both
    ends, NULLs in the first: together they hold every row exactly once."""
    marks = sorted(days)
    if not marks:
        return ["1 = 1"]
    name = f"`{column}`"
    return [f"{name} < '{marks[0]}' OR {name} IS NULL",
            *[f"{name} >= '{a}' AND {name} < '{b}'" for a, b in zip(marks, marks[1:])],
            f"{name} >= '{marks[-1]}'"]


# --------------------------------------------------------------------------
# Sources: table name -> DataFrame
# --------------------------------------------------------------------------

TableSource = Callable[[str], DataFrame]


def jdbc_source(spark: SparkSession, settings: Mapping[str, str],
                splits: Mapping[str, RangeSplit | Sequence[str]] | None = None,
                fetchsize: int = DEFAULT_FETCHSIZE) -> TableSource:
    """ERP tables over JDBC.  Column pruning and simple filters reach the
    database; tables named in ``splits`` are read by parallel tasks, by ranges
    of a column or by one task for each predicate of a list.  Other tables
    come through one connection."""
    options = jdbc_options(settings, fetchsize)

    def read(table: str) -> DataFrame:
        split = (splits or {}).get(table)
        if split is None or isinstance(split, RangeSplit):
            more = split.options() if split else {}
            return spark.read.format("jdbc").options(**options, dbtable=f"`{table}`", **more).load()
        rest = {k: v for k, v in options.items() if k != "url"}
        return spark.read.jdbc(options["url"], f"`{table}`", predicates=list(split), properties=rest)
    return read


def parquet_source(spark: SparkSession, root: str, ds: str | None = None, key: str = "name",
                   version: str = "modified") -> TableSource:
    """ERP tables stored as ``<root>/<safe name>`` Parquet folders.

    Where a folder holds daily extracts, ``ds`` reads that day alone; without
    it each ``key`` gives its latest version (by ``version``, then day), so a
    row that was extracted on several days comes back once.  Rows without a
    key are all kept."""
    def read(table: str) -> DataFrame:
        df = spark.read.parquet(f"{root.rstrip('/')}/{safe_table_name(table)}")
        if "ds" not in df.columns:
            return df
        if ds is not None:
            return df.where(F.col("ds").cast("string") == ds).drop("ds")
        if key not in df.columns:
            raise ValueError(f"{table} holds daily extracts without {key!r}: name a day")
        order = [F.col(c).desc_nulls_last() for c in (version, "ds") if c in df.columns]
        newest = Window.partitionBy(key).orderBy(*order)
        keyed = (df.where(F.col(key).isNotNull()).withColumn("__newest", F.row_number().over(newest))
                 .where(F.col("__newest") == 1).drop("__newest"))
        # rows without a key go around the window: they are not one group for one task to sort
        return keyed.unionByName(df.where(F.col(key).isNull())).drop("ds")
    return read


def frame_source(frames: Mapping[str, DataFrame]) -> TableSource:
    """Tables already held as DataFrames (tests, derived views)."""
    return lambda table: frames[table]


def collated_source(source: TableSource, collation: str = CASE_INSENSITIVE,
                    columns: Mapping[str, Sequence[str]] | None = None) -> TableSource:
    """``source`` with its text under a collation, as the source database compares it: all text columns of
    every table, or those named for each table (other tables as they are)."""
    def read(table: str) -> DataFrame:
        if columns is None:
            return collated(source(table), collation)
        return collated(source(table), collation, columns.get(table, ()))
    return read


# --------------------------------------------------------------------------
# Query scans
# --------------------------------------------------------------------------

def sql_literal(value: object) -> str:
    """A value as a literal of a MySQL-protocol server."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, (int, float, decimal.Decimal)):
        return str(value)
    if isinstance(value, (str, dt.date)):
        return "'" + str(value).replace("\\", "\\\\").replace("'", "''") + "'"
    raise TypeError(f"no literal for {type(value).__name__}")


_MARKER = re.compile(r"""'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.|"")*"|`[^`]*`|:([A-Za-z_]\w*)""", re.S)


def bind(query: str, args: Mapping[str, object]) -> str:
    """``query`` with its ``:name`` markers replaced by literals; quoted text
    is left alone, and an unknown marker is an error."""
    return _MARKER.sub(lambda m: sql_literal(args[m[1]]) if m[1] else m[0], query)


def scan_query_jdbc(spark: SparkSession, settings: Mapping[str, str], query: str,
                    args: Mapping[str, object] | None = None, fetchsize: int = DEFAULT_FETCHSIZE) -> DataFrame:
    """S2/S3 over JDBC: the database runs ``query`` with its parameters bound;
    rows stream in ``fetchsize`` batches through one connection."""
    return (spark.read.format("jdbc").options(**jdbc_options(settings, fetchsize))
            .option("query", bind(query, args) if args else query).load())


def scan_query(spark: SparkSession, source: TableSource, tables: list[str], query: str,
               args: Mapping[str, object] | None = None) -> DataFrame:
    """Run SQL text over named ERP tables with Spark SQL.  Table
    names with spaces are written in backticks (`` `tabSales Invoice` ``);
    ``args`` binds ``:name`` parameter markers (no string splicing).  The
    tables are common table expressions of this statement alone: the session's
    views are neither used for them nor replaced."""
    frames = {f"t{i}": source(t) for i, t in enumerate(tables)}
    named = ", ".join(f"`{t.replace('`', '``')}` AS (TABLE {{t{i}}})" for i, t in enumerate(tables))
    body = query.replace("{", "{{").replace("}", "}}")
    own = re.match(r"(?is)\s*WITH\s+(?!RECURSIVE\b)", body)
    text = f"WITH {named}, {body[own.end():]}" if own else f"WITH {named} {body}"
    return spark.sql(text, args=dict(args) if args else None, **frames)


# --------------------------------------------------------------------------
# writes
# --------------------------------------------------------------------------

@dataclass(frozen=True)
class ExtractResult:
    path: str
    rows: int


def _where(df: DataFrame, where: str | Column | None) -> DataFrame:
    if where is None:
        return df
    return df.where(F.expr(where) if isinstance(where, str) else where)


def conform_schema(df: DataFrame, schema: StructType) -> DataFrame:
    """One fixed schema for the output (columns by name, cast)."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def extract_query(df: DataFrame, output_path: str, compression: str = DEFAULT_COMPRESSION,
                  schema: StructType | None = None, partition_by: list[str] | None = None) -> ExtractResult:
    """Write a query result as Parquet; returns the path and the row
    count, observed while writing (no second scan).  The commit is all or
    nothing; with ``partition_by`` and dynamic overwrite only the partitions
    present in ``df`` are replaced."""
    if schema is not None:
        df = conform_schema(df, schema)
    obs = Observation(f"extract_{uuid.uuid4().hex[:8]}")
    w = df.observe(obs, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").option("compression", compression)
    if partition_by:
        # per-write option: only the partitions present in df are replaced
        w = w.partitionBy(*partition_by).option("partitionOverwriteMode", "dynamic")
    w.parquet(output_path)
    rows = int(obs.get.get("rows", 0))
    if rows == 0:
        log.warning("extract wrote no rows: %s", output_path)
    return ExtractResult(output_path, rows)


def extract_table(source: TableSource, table: str, output_path: str, columns: list[str] | None = None,
                  where: str | Column | None = None, compression: str = DEFAULT_COMPRESSION) -> ExtractResult:
    """One table, optional column list and row predicate; both reach
    the source scan (JDBC / Parquet pushdown)."""
    df = source(table)
    df = _where(df, where)
    if columns:
        df = df.select(*columns)
    return extract_query(df, output_path, compression)


def incremental_filter(ds: str, column: str = "modified") -> Column:
    """Rows changed on or after the day (inclusive high-water mark).
    The bound is a wall-clock timestamp, like the source database's DATETIME
    compared with a date string, so the session time zone does not move it."""
    return F.col(column) >= F.lit(ds).cast("timestamp_ntz")


def partition_path(output_dir: str, table: str) -> str:
    return f"{output_dir.rstrip('/')}/{safe_table_name(table)}"


def extract_partition(source: TableSource, table: str, output_dir: str, ds: str | None = None,
                      where: str | Column | None = None, columns: list[str] | None = None) -> ExtractResult:
    """Write ``<output_dir>/<table>/ds=<ds>`` (``manual_run`` without a
    day).  The day's own folder is overwritten, so a re-run replaces exactly
    that day, also when it now has no rows; other days are untouched."""
    day = ds or "manual_run"
    df = _where(source(table), where)
    if columns:
        df = df.select(*columns)
    return extract_query(df, f"{partition_path(output_dir, table)}/ds={day}")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory."""
    return f"{checkpoint_dir(spark).rstrip('/')}/ledgerlake/{name}-{uuid.uuid4().hex[:12]}"
