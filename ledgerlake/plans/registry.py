"""Query registry: key -> (Spark plan, DuckDB oracle text).

A plan is ``fn(spark, sf_dir) -> DataFrame`` over the ERP views derived
from a test-data directory.  The oracle is an independent DuckDB statement
over the same derivations (prefixed automatically as CTEs).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerlake.sources.fixtures import with_oracle_prefix

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
ORACLE_BODIES: dict[str, str] = {}   # the same statements without the derivation prefix

# Report parameters for the test data (orders span 1995-01-01..2001-08-01).
AS_OF = dt.date(1998, 7, 10)
START = dt.date(1998, 7, 1)
END = dt.date(1998, 7, 31)
MONTHLY_TARGET = 135_000_000
COMPANY = "CO-1"


def register(key: str, oracle: str | None = None):
    def deco(fn):
        if key in QUERIES:
            raise KeyError(f"duplicate query key {key}")
        QUERIES[key] = fn
        if oracle is not None:
            ORACLES[key] = with_oracle_prefix(oracle)
            ORACLE_BODIES[key] = oracle
        return fn
    return deco


def sql_date(d: dt.date) -> str:
    return f"DATE '{d.isoformat()}'"


def msum(expr: str) -> str:
    """Exact money sum in the oracle, as in ``functions.money``."""
    return f"SUM(CAST({expr} AS DECIMAL(18,4)))"


def dsum(expr: str) -> str:
    return f"CAST({msum(expr)} AS DOUBLE)"
