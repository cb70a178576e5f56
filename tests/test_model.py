"""Whole-model integrity, the split merge, exact allocation."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from conftest import MEDIUM
from ledgerlake.operators import integrity as I
from ledgerlake.operators import model_checks as M
from ledgerlake.operators import sales as S
from ledgerlake.plans import catalog


def small_model(spark, **changed):
    tables = {
        "customers": [(1, "A"), (2, "B")], "products": [(10, "P")], "channels": [(1, "web")],
        "purchase_history": [(1, 10, 1, "2026-01-01 00:00:00"), (None, None, None, "2026-01-01 00:00:00")],
        "visit_history": [(2, 1, "2026-01-01 00:00:00")]} | changed
    names = {"customers": "customer_id long, customer_name string", "products": "product_sku long, product_name string",
             "channels": "channel_id long, channel_name string",
             "purchase_history": "customer_id long, product_sku long, channel_id long, order_date string",
             "visit_history": "customer_id long, channel_id long, visit_timestamp string"}
    return {t: spark.createDataFrame(rows, names[t]) for t, rows in tables.items()}


def violations(tables):
    return sorted(((r["table_name"], r["constraint"], r["column_name"], r["value"], r["rows"])
                   for r in M.check_model(tables).collect()), key=str)


def test_a_valid_model_has_no_violations(spark):
    assert violations(small_model(spark)) == []
    assert violations({t: df.limit(0) for t, df in small_model(spark).items()}) == []


def test_every_constraint_is_reported(spark):
    tables = small_model(
        spark, customers=[(1, "A"), (1, "B"), (None, "x" * 151), (None, "é" * 150)], channels=[(1, "web")],
        purchase_history=[(1, 10, 1, None), (2, 11, 1, "2026-01-01 00:00:00"), (2, 11, 1, None)],
        visit_history=[(1, 9, "2026-01-01 00:00:00")])
    assert violations(tables) == sorted([
        ("customers", "primary key", "customer_id", "1", 2), ("customers", "primary key", "customer_id", None, 2),
        ("customers", "length", "customer_name", None, 1), ("purchase_history", "not null", "order_date", None, 2),
        ("purchase_history", "foreign key", "customer_id", "2", 2), ("purchase_history", "foreign key", "product_sku", "11", 2),
        ("visit_history", "foreign key", "channel_id", "9", 1)], key=str)


def test_each_table_is_read_once_and_references_need_no_join(spark):
    plan = M.check_model(small_model(spark))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") == 5 and "Join" not in plan


def test_a_model_that_contradicts_itself_is_refused():
    with pytest.raises(ValueError):
        M.Model(I.CUSTOMER_MODEL, {"customers": ["customer_id"]}, {"visit_history": [("channel_id", "channels", "channel_id")]})
    with pytest.raises(ValueError):
        M.Model(I.CUSTOMER_MODEL, {"customers": ["nope"]})
    with pytest.raises(ValueError):
        M.check_model({})


# ---------------------------------------------------------------- merge

def test_upsert_is_a_left_join_and_an_anti_join(spark):
    plan = catalog.QUERIES["upsert_stamp"](spark, MEDIUM)._jdf.queryExecution().optimizedPlan().toString()
    assert "FullOuter" not in plan and "LeftOuter" in plan and "LeftAnti" in plan


def test_upsert_splits_hot_keys_of_the_table(spark):
    """A third of the table under one key, half of the batch under another: every row is there once."""
    old, new = dt.datetime(1995, 1, 1), dt.datetime(2026, 1, 1)
    current = I.apply_defaults(
        spark.range(9000).select(F.when(F.col("id") < 3000, 5).when(F.col("id") < 3500, None).otherwise(F.col("id")).alias("k"),
                                 F.lit(1).alias("v"), F.sha2(F.col("id").cast("string"), 512).alias("note")), {}, F.lit(old).cast("timestamp_ntz"))
    incoming = spark.range(4000).select(F.when(F.col("id") < 2000, -1).when(F.col("id") < 2500, None).otherwise(5).alias("k"),
                                        F.col("id").cast("int").alias("v"))
    conf = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1KB",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4KB", "spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        out = I.upsert_stamp(current, incoming, ["k"], F.lit(new).cast("timestamp_ntz"))
        rows = out.collect()
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert "skew=true" in plan
    assert len(rows) == 9001
    assert sum(r["k"] == 5 and r["v"] == 3999 and r["updated_at"] == new for r in rows) == 3000
    assert sum(r["k"] is None and r["v"] == 2499 for r in rows) == 500
    assert [(r["v"], r["created_at"]) for r in rows if r["k"] == -1] == [(1999, new)]


# ---------------------------------------------------------------- allocation

def plain_allocation(amount, weights):
    """Largest remainder in whole cents."""
    sign, units = (-1 if amount < 0 else 1), abs(int(amount * 100))
    total = sum(w for _, w in weights)
    parts = [[units * w // total, -(units * w % total), p] for p, w in sorted(weights)]
    left = units - sum(q for q, _, _ in parts)
    for part in sorted(parts, key=lambda x: (x[1], x[2]))[:left]:
        part[0] += 1
    return {p: sign * Decimal(q) / 100 for q, _, p in parts}


@pytest.mark.parametrize("weight", [None, "w"])
def test_parts_add_up_to_the_line(spark, weight):
    rng = random.Random(5)
    team, lines, want = [], [], []
    for d in range(60):
        persons = [(f"p{i}", rng.randint(1, 70)) for i in rng.sample(range(9), rng.randint(0, 6))]
        team += [(f"D{d}", p, w) for p, w in persons]
        for line in range(3):
            amount = Decimal(rng.randint(-100000, 100000)) / 100
            lines.append((f"D{d}", f"{d}-{line}", amount))
            parts = plain_allocation(amount, [(p, w if weight else 1) for p, w in persons]) if persons else {None: amount}
            want += [(f"{d}-{line}", p, v) for p, v in parts.items()]
    t = spark.createDataFrame(team, "parent string, sales_person string, w int")
    df = spark.createDataFrame(lines, "document string, line string, amount decimal(18,2)")
    got = S.allocate(df, t, "document", "amount", weight=weight)
    assert got.columns == ["document", "line", "amount", "sales_person", "allocated"]
    assert sorted(((r["line"], r["sales_person"], r["allocated"]) for r in got.collect()), key=str) == sorted(want, key=str)


def test_nulls_repeats_and_thirds(spark):
    team = spark.createDataFrame([("D", "b"), ("D", "a"), ("D", "c"), ("D", "a"), ("D", None), (None, "x")],
                                 "parent string, sales_person string")
    df = spark.createDataFrame([("D", 1.0), ("D", None), ("E", 2.5), (None, 3.0), ("D", -0.01)], "document string, amount double")
    got = sorted(((r["document"], r["amount"], r["sales_person"], r["allocated"])
                  for r in S.allocate(df, team, "document", "amount").collect()), key=str)
    assert got == sorted([
        ("D", 1.0, "a", Decimal("0.34")), ("D", 1.0, "b", Decimal("0.33")), ("D", 1.0, "c", Decimal("0.33")),
        ("D", None, "a", None), ("D", None, "b", None), ("D", None, "c", None), ("E", 2.5, None, Decimal("2.50")),
        (None, 3.0, "x", Decimal("3.00")), ("D", -0.01, "a", Decimal("-0.01")), ("D", -0.01, "b", Decimal("0.00")),
        ("D", -0.01, "c", Decimal("0.00"))], key=str)


def test_allocated_total_is_the_unfanned_total(spark):
    from ledgerlake.sources.fixtures import ErpViews
    v = ErpViews(spark, MEDIUM)
    total = v.sales_order_item.agg(F.sum((F.col("qty") * F.col("rate")).cast("decimal(18,2)"))).first()[0]
    parts = catalog.QUERIES["j_fanout_allocated"](spark, MEDIUM).collect()
    assert sum(Decimal(repr(r["amount"])) for r in parts) == total
    plain = catalog.QUERIES["j_fanout"](spark, MEDIUM).count()
    deduped = catalog.QUERIES["j_fanout_deduped"](spark, MEDIUM).count()
    assert deduped == v.sales_order.count() < plain
