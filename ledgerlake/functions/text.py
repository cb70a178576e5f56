"""Text comparison under a collation, chosen per call.

The source database usually compares names without regard to case; Spark
compares bytes unless a column says otherwise.  A collated column carries its
rule through ``=``, ``IN``, ``LIKE``, grouping, joins and sorting, and literals
compared with it follow it, so the reports run unchanged on collated tables.
Filters on collated columns are not pushed into Parquet; name the columns
(``columns=``) where that matters.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Lower-cased comparison, accents kept apart.
CASE_INSENSITIVE = "UTF8_LCASE"


def collated(df: DataFrame, collation: str = CASE_INSENSITIVE, columns: Sequence[str] | None = None) -> DataFrame:
    """``df`` with its text columns (or those named) under the collation; other columns are untouched."""
    chosen = set(columns) if columns is not None else {f.name for f in df.schema if isinstance(f.dataType, StringType)}
    unknown = chosen - set(df.columns)
    if unknown:
        raise ValueError(f"no columns {sorted(unknown)}")
    return df.select(*[F.collate(F.col(c), collation).alias(c) if c in chosen else F.col(c) for c in df.columns])


def binary_text(df: DataFrame) -> DataFrame:
    """``df`` with every text column compared by bytes again (for writing and for other readers)."""
    return df.select(*[F.col(f.name).cast("string").alias(f.name) if isinstance(f.dataType, StringType)
                       else F.col(f.name) for f in df.schema])
