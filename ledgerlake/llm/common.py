"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.session import checkpoint_dir

# Where the package is installed.
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
# The white space of the contracts, [\x20\x09-\x0D].
WHITE_SPACE = (" ", "\t", "\n", "\x0b", "\x0c", "\r")


# What operators keep in a Python worker between tasks: name -> how to forget it.
_kept: dict[str, Callable[[], object]] = {}


def make_room(owner: str = "") -> None:
    """Forgets what operators other than ``owner`` keep in this worker.  Workers outlive their stage; without
    this an encoder's tables would stay in memory under every later stage of the same session."""
    for name in [n for n in _kept if n != owner]:
        _kept.pop(name)()


def keep(owner: str, forget: Callable[[], object]) -> None:
    """Says that ``owner`` keeps tables in this worker, which ``forget`` drops; others' go first."""
    make_room(owner)
    _kept[owner] = forget


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data directory; the workers of ``spark`` get this package on their path."""
    paths = spark.sparkContext.environment
    if ROOT not in paths.get("PYTHONPATH", "").split(os.pathsep):
        paths["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, paths.get("PYTHONPATH", "")]))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(name: str) -> Column:
    """A column by its exact name, dots and blanks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(taken: Iterable[str], *names: str) -> list[str]:
    """The names, prefixed with underscores until none clashes with ``taken`` (case ignored)."""
    used = {t.lower() for t in taken}
    out = []
    for name in names:
        while name.lower() in used:
            name = "_" + name
        used.add(name.lower())
        out.append(name)
    return out


def shared(df: DataFrame) -> DataFrame:
    """``df`` written to ``spark.checkpoint.dir``: computed once, and safe from a lost executor."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        checkpoint_dir(spark)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under ``spark.checkpoint.dir``."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet under ``spark.checkpoint.dir``: computed once, read by columns."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def row_key(df: DataFrame, id_col: str, text_col: str) -> Column:
    """A digest that tells rows of one id but different texts apart."""
    return F.xxhash64(F.coalesce(named(text_col), F.lit("")), named(id_col).isNull())
