"""Exact sums of nine-decimal amounts and of their products, against Python's decimals."""

import random
from decimal import ROUND_HALF_UP, Decimal, localcontext

import pytest

from ledgerlake.functions import exact_sum
from ledgerlake.operators import ledger
from ledgerlake.plans import catalog

NINE = Decimal("0.000000001")


def exact(values):
    with localcontext() as c:
        c.prec = 90
        return sum(values).quantize(NINE, ROUND_HALF_UP)


@pytest.mark.parametrize("seed", range(3))
def test_sums_and_products_match_decimals(spark, seed):
    rng = random.Random(seed)

    def number(top):
        return rng.choice([-1, 1]) * (Decimal(rng.randrange(10 ** rng.randint(1, top))) + rng.randrange(10 ** 9) * NINE)
    rows = [(number(16), number(5), rng.randint(0, 4)) for _ in range(400)]
    rows += [(None, NINE, 0), (NINE, None, 0), (None, None, 9)]
    df = spark.createDataFrame(rows, "a decimal(30,9), f decimal(30,9), k int")
    got = {r["k"]: r for r in df.groupBy("k").agg(exact_sum("a").alias("s"), exact_sum("a", "f").alias("p")).collect()}
    for k in range(5):
        assert got[k]["s"] == exact([a for a, _, g in rows if g == k and a is not None])
        with localcontext() as c:
            c.prec = 90
            products = [a * f for a, f, g in rows if g == k and a is not None and f is not None]
        assert got[k]["p"] == exact(products)
    assert got[9]["s"] is None and got[9]["p"] is None


def test_large_amounts_small_products_and_halves(spark):
    df = spark.createDataFrame([(1e18, 0.1), (-0.3, 0.1), (123.123456789, 1.5)], "a double, f double")
    row = df.agg(exact_sum("a").alias("s"), exact_sum("a", "f").alias("p")).first()
    assert row["s"] == Decimal("1000000000000000122.823456789")
    assert row["p"] == Decimal("100000000000000184.655185184")      # ...1835 rounds away from zero, once
    tiny = spark.createDataFrame([("0.00005", "0.00001")] * 3, "a string, f string")
    assert tiny.agg(exact_sum("a", "f").alias("p")).first()["p"] == Decimal("0.000000002")   # 3 x 0.0000000005
    back = spark.createDataFrame([("-0.00005", "0.00001")] * 3, "a string, f string")
    assert back.agg(exact_sum("a", "f").alias("p")).first()["p"] == Decimal("-0.000000002")


def test_order_and_layout_do_not_matter(spark):
    df = spark.range(2000).selectExpr("CAST(id * 1000003 % 997 AS DECIMAL(18,9)) / 7 AS a", "id % 3 AS k")
    one, many = (sorted(map(tuple, d.groupBy("k").agg(exact_sum("a", "a").alias("p")).collect()))
                 for d in (df.coalesce(1), df.repartition(7)))
    assert one == many


def test_outstanding_in_base_multiplies_foreign_invoices_only(spark):
    rows = [("S", 1, "USD", "10.000000001", "129.123456789"), ("S", 1, "KES", "5", None), ("S", 2, "USD", "99", "1"),
            ("T", 1, "USD", "1", None)]
    pi = spark.createDataFrame(rows, "supplier string, docstatus int, party_account_currency string, "
                                     "outstanding_amount string, conversion_rate string")
    got = {r["supplier_id"]: r["outstanding"] for r in ledger.outstanding_in_base(pi).collect()}
    assert got == {"S": Decimal("1296.234568019"), "T": None}


@pytest.mark.parametrize("parts", [[0, 19_999, 126_278], [126_279, 1_199_999], [10 ** 12 + 1, 2 ** 63 - 1, -2 ** 63]])
def test_a_sum_exact_takes_any_part_key(spark, tmp_path, parts):
    """Units of nine digits, as at 60 times sf0.1 of ten, and up to the largest keys (F1 of round 3)."""
    rows = [(p, s, n, price) for p in parts for s, n, price in
            [(1, 1, 104999.91), (1, 7, 900.68), (1, 7, 900.68), (p % 3 + 2, 3, 0.01), (None, 2, -5.25)]]
    rows += [(None, 1, 1, 10.0), (parts[0], 1, None, 10.0), (parts[0], 1, 1, None), (None, 9, 1, 1.0)]
    spark.createDataFrame(rows, "l_partkey bigint, l_suppkey bigint, l_linenumber int, l_extendedprice double") \
        .write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r["l_suppkey"]: (r["total"], r["rounded_total"])
           for r in catalog.QUERIES["a_sum_exact"](spark, str(tmp_path)).collect()}
    amounts = {s: [] for _, s, _, _ in rows}
    for p, s, n, price in rows:
        if None not in (p, n, price):
            amounts[s].append(Decimal(str(price)) + (p * 7919 + n) * NINE)
    assert got.pop(9) == (None, None) and not amounts.pop(9)
    assert got == {s: (str(exact(a)), float(exact(a).quantize(Decimal("0.01"), ROUND_HALF_UP)))
                   for s, a in amounts.items()}
