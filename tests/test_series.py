"""Running sums: against brute force with peers, nulls and hot days; the plan has no window over everything."""

import random
import re

import pytest

from conftest import MEDIUM
from ledgerlake.operators import series
from ledgerlake.plans import catalog


def brute(rows, value_of):
    """SUM over the rows at or before each row's order value (NULL first), skipping NULLs."""
    out = []
    for r in rows:
        seen = [x[2] for x in rows if value_of(x, r) and x[2] is not None and (
            x[0] is None or (r[0] is not None and x[0] <= r[0]))]
        out.append((*r, sum(seen) if seen else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("ranges", [1, 2, 7, 100])
@pytest.mark.parametrize("by", [[], ["k"]])
def test_running_total_matches_brute_force(spark, ranges, by):
    rng = random.Random(ranges)
    # a third of the rows share one order value
    rows = [(13 if rng.random() < .33 else rng.choice([None, *range(40)]), rng.choice(["a", "b", None]),
             rng.choice([None, *range(-5, 9)])) for _ in range(300)]
    df = spark.createDataFrame(rows, "d int, k string, v long")
    got = series.running_total(df, "v", "d", "run", by=by, ranges=ranges)
    assert got.columns == ["d", "k", "v", "run"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, lambda x, r: not by or x[1] == r[1])


@pytest.mark.parametrize("kind, values", [
    ("date", "1998-01-01 1998-01-02 1998-03-05 2001-07-01".split()), ("string", ["", "Z", "a", "é", "日"]),
    ("double", ["-1.5", "0.0", "2.25", "NaN"]), ("decimal(18,4)", ["-2.0001", "0", "7.5"]),
    ("timestamp_ntz", ["1998-01-01 00:00:00", "1998-01-01 00:00:01", "1999-05-05 12:00:00"])])
def test_any_orderable_type(spark, kind, values):
    rows = [(v, i + 1) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows[::-1], "d string, v long").selectExpr(f"CAST(d AS {kind}) AS d", "v")
    got = series.running_sums(df, "v", "d", "run", ranges=3).collect()
    assert sorted((r["v"], r["run"]) for r in got) == [(i, i * (i + 1) // 2) for i in range(1, len(values) + 1)]


def test_empty_and_all_null(spark):
    none = spark.createDataFrame([], "d date, v long")
    assert series.running_total(none, "v", "d", "run").collect() == []
    nulls = spark.createDataFrame([(None, None), (None, None)], "d date, v long")
    assert [r["run"] for r in series.running_total(nulls, "v", "d", "run").collect()] == [None, None]


@pytest.mark.parametrize("key", ["w_running_sum", "w_running_sum_of_sum", "w_running_balance"])
def test_every_window_is_split(spark, key):
    plan = catalog.QUERIES[key](spark, MEDIUM)._jdf.queryExecution().executedPlan().toString()
    windows = re.findall(r"Window \[[^\n]*", plan)
    assert windows and all("__range" in w or "account" in w for w in windows)


def test_splitters_do_not_depend_on_the_layout(spark):
    df = spark.range(5000).selectExpr("(id * 7919) % 4001 AS d")
    cuts = [series._sampled_splitters(df.repartition(n), "d", 16) for n in (1, 7)]
    assert cuts[0] == cuts[1] == sorted(set(cuts[0])) and len(cuts[0]) == 15
