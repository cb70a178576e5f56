"""Comparison of a Spark result with a DuckDB oracle result (tests, scripts).

Row count, column names, column types and the sorted rows must agree;
doubles must be bit-equal (sums are exact decimals on both sides).
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os

RAW_TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
              "benchmark labels conversations").split()

SPARK_TO_DUCK = {"string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "date": "DATE",
                 "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP WITH TIME ZONE",
                 "smallint": "SMALLINT", "float": "FLOAT", "tinyint": "TINYINT"}


def duck_connection(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in RAW_TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if isinstance(v, float):
        return ("nan",) if math.isnan(v) else (0.0 if v == 0 else v)
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    return v


def _key(row):
    return tuple((0, "") if x is None else (1, type(x).__name__, x) for x in row)


def compare(sdf, con, sql: str) -> tuple[int, list[str]]:
    """Run both sides; return (rows, problems)."""
    srows = [tuple(_norm(x) for x in r) for r in sdf.collect()]
    scols = sdf.columns
    res = con.execute(sql)
    ocols = [d[0] for d in res.description]
    duck_types = {d[0]: str(d[1]) for d in res.description}
    orows = [tuple(_norm(x) for x in r) for r in res.fetchall()]
    problems = []
    for f in sdf.schema.fields:
        st = f.dataType.simpleString()
        got = duck_types.get(f.name)
        if got is None or (st.startswith("decimal") and got.startswith("DECIMAL")):
            continue
        if SPARK_TO_DUCK.get(st, st.upper()) != got:
            problems.append(f"type {f.name}: spark {st} / oracle {got}")
    if sorted(scols) != sorted(ocols):
        problems.append(f"columns spark={scols} oracle={ocols}")
        return len(srows), problems
    idx = [ocols.index(c) for c in scols]
    orows = [tuple(r[i] for i in idx) for r in orows]
    if len(srows) != len(orows):
        problems.append(f"rows spark={len(srows)} oracle={len(orows)}")
        return len(srows), problems
    diffs = [(a, b) for a, b in zip(sorted(srows, key=_key), sorted(orows, key=_key)) if a != b]
    if diffs:
        problems.append(f"{len(diffs)} rows differ, e.g. spark={diffs[0][0]} oracle={diffs[0][1]}")
    return len(srows), problems
