"""Incremental pulls with a committed high-water table.

A pull copies the rows whose ``modified`` is at or above the last committed
mark, less an overlap for rows that became visible late, into a folder of its
own, and only then adds one row to the log: range, rows, path.  What is not in
the log does not exist: a pull that broke off leaves a folder that nobody
reads, and the next one starts from the same mark.  Rows that overlapping or
repeated pulls hold twice are settled when the table is read, by key and
version.

    <root>/<table>/__pull=<id>/...    rows of one pull
    <root>/<table>__log/...           one row for each committed pull
"""

from __future__ import annotations

import datetime as dt
import logging
import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType, TimestampNTZType

from ledgerlake.functions.erp import safe_table_name
from ledgerlake.sources.extract import DEFAULT_COMPRESSION, TableSource

log = logging.getLogger(__name__)

LOG_SCHEMA = StructType([
    StructField("pull", StringType(), False), StructField("seq", LongType(), False),
    StructField("low", TimestampNTZType()), StructField("high", TimestampNTZType()),
    StructField("rows", LongType(), False), StructField("path", StringType(), False)])


@dataclass(frozen=True)
class Pull:
    """One pull: rows at or above ``low`` (None: all) up to ``high``, the new mark."""
    pull: str
    seq: int
    low: dt.datetime | None
    high: dt.datetime | None
    rows: int
    path: str


def _folder(root: str, table: str) -> str:
    return f"{root.rstrip('/')}/{safe_table_name(table)}"


def _missing(e: AnalysisException) -> bool:
    return e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


def committed(spark: SparkSession, root: str, table: str) -> DataFrame:
    """The log: one row for each committed pull (none before the first)."""
    try:
        return spark.read.schema(LOG_SCHEMA).parquet(_folder(root, table) + "__log")
    except AnalysisException as e:
        if not _missing(e):
            raise
        return spark.createDataFrame([], LOG_SCHEMA)


def mark(spark: SparkSession, root: str, table: str) -> tuple[int, dt.datetime | None]:
    """(number of the last committed pull, greatest ``modified`` that is committed)."""
    row = committed(spark, root, table).agg(F.coalesce(F.max("seq"), F.lit(0)).alias("seq"), F.max("high").alias("high")).first()
    return row["seq"], row["high"]


def copy_rows(source: TableSource, table: str, root: str, low: dt.datetime | None, column: str = "modified",
              seq: int = 1, compression: str = DEFAULT_COMPRESSION) -> Pull:
    """First half of a pull: the rows are written, but not yet committed."""
    df = source(table)
    if low is not None:
        # rows without a time cannot be told apart from older pulls': they come with every pull and settle by key
        bound = F.lit(low.isoformat(sep=" ")).cast("timestamp_ntz")
        df = df.where((F.col(column) >= bound) | F.col(column).isNull())
    name = f"p{uuid.uuid4().hex}"        # never read as a number
    path = f"{_folder(root, table)}/__pull={name}"
    seen = Observation(f"pull_{name}")
    (df.observe(seen, F.count(F.lit(1)).alias("rows"), F.max(F.col(column).cast("timestamp_ntz").cast("string")).alias("high"))
     .write.option("compression", compression).parquet(path))
    high = seen.get["high"]
    if seen.get["rows"] == 0:
        log.warning("pull found no rows: %s", path)
    return Pull(name, seq, low, dt.datetime.fromisoformat(high) if high else low, int(seen.get["rows"]), path)


def commit(spark: SparkSession, root: str, table: str, pull: Pull) -> None:
    """Second half: one row in the log, written by one task."""
    row = (pull.pull, pull.seq, pull.low, pull.high, pull.rows, pull.path)
    spark.createDataFrame([row], LOG_SCHEMA).coalesce(1).write.mode("append").parquet(_folder(root, table) + "__log")


def pull(spark: SparkSession, source: TableSource, table: str, root: str, column: str = "modified",
         overlap: dt.timedelta = dt.timedelta(0)) -> Pull:
    """Copies and commits what is at or above the committed mark less ``overlap`` (inclusive)."""
    seq, high = mark(spark, root, table)
    done = copy_rows(source, table, root, None if high is None else high - overlap, column, seq + 1)
    if high is not None and (done.high is None or done.high < high):
        done = Pull(done.pull, done.seq, done.low, high, done.rows, done.path)      # the mark never falls
    commit(spark, root, table, done)
    return done


def read(spark: SparkSession, root: str, table: str, key: str = "name", version: str = "modified") -> DataFrame:
    """The table as the committed pulls know it: of each key the row of the latest version, then of the latest pull.

    Rows without a key cannot be matched; equal ones count as often as the pull that holds most of them has them.
    """
    log_rows = committed(spark, root, table).select(F.col("pull").alias("__pull"), F.col("seq").alias("__seq"), "path")
    paths = [r["path"] for r in log_rows.select("path").collect()]       # one for each run of the extract
    if not paths:
        raise FileNotFoundError(f"no committed pull of {table}")
    every = (spark.read.option("basePath", _folder(root, table)).option("mergeSchema", "true").parquet(*paths)
             .join(F.broadcast(log_rows.drop("path")), "__pull").drop("__pull"))
    cols = [c for c in every.columns if c != "__seq"]
    loose = (every.where(F.col(key).isNull()).groupBy(*cols, "__seq").agg(F.count(F.lit(1)).alias("__n"))
             .groupBy(*cols).agg(F.max("__n").alias("__n"))
             .withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__n").cast("int")))))
    return newest(every.where(F.col(key).isNotNull()), [key], [version, "__seq"]).select(*cols).unionByName(loose.select(*cols))


def newest(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row for each key: the last by ``order`` (NULLs least), of equal ones by a digest of the row."""
    rank = Window.partitionBy(*key).orderBy(*[F.col(c).desc_nulls_last() for c in order],
                                            F.xxhash64(*[F.col(c) for c in df.columns]))
    return df.withColumn("__newest", F.row_number().over(rank)).where(F.col("__newest") == 1).drop("__newest")
