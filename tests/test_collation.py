"""Reports over names in mixed spelling: equal under a collation, apart without it."""

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from ledgerlake.functions import binary_text, collated
from ledgerlake.operators import ledger as L
from ledgerlake.operators.relational import collated_groups
from ledgerlake.plans import catalog, finance
from ledgerlake.plans.registry import END, START
from ledgerlake.sources.extract import collated_source, frame_source
from ledgerlake.sources.fixtures import ErpViews


@pytest.fixture(scope="module")
def names(spark):
    return spark.createDataFrame([("USD", 1), ("usd", 2), ("Kes", 4), (None, 8), (None, 16), ("ÉTÉ", 32), ("été", 64)],
                                 "c string, v long")


def test_grouping_joins_and_lists_follow_the_column(spark, names):
    ci = collated(names, columns=["c"])
    assert sorted(r["s"] for r in ci.groupBy("c").agg(F.sum("v").alias("s")).collect()) == [3, 4, 24, 96]
    other = collated(spark.createDataFrame([("uSd",), ("KES",)], "c string"))
    assert sorted(r["v"] for r in ci.join(other, "c").collect()) == [1, 2, 4]
    assert sorted(r["v"] for r in ci.join(other, "c", "left_anti").collect()) == [8, 16, 32, 64]
    assert ci.where(F.col("c").isin("USD", "kes")).count() == 3
    assert ci.where(F.col("c").like("%SD")).count() == 2
    assert names.where(F.col("c").isin("USD", "kes")).count() == 1


def test_least_spelling_does_not_depend_on_the_layout(names):
    want = [(None, 24), ("Kes", 4), ("USD", 3), ("ÉTÉ", 96)]
    for n in (1, 5):
        got = collated_groups(names.repartition(n), ["c"], {"s": F.sum("v")})
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
        assert got.schema["c"].dataType.simpleString() == "string"


def test_two_key_groups(spark):
    df = spark.createDataFrame([("a", "X", 1), ("A", "x", 2), ("A", "y", 4)], "k string, j string, v long")
    assert sorted(map(tuple, collated_groups(df, ["k", "j"], {"s": F.sum("v")}).collect())) == [("A", "X", 3), ("A", "y", 4)]


def test_source_wraps_all_or_named_columns(names):
    src = frame_source({"t": names, "u": names})
    every = collated_source(src)("t").schema["c"].dataType
    assert every.simpleString() != "string"
    some = collated_source(src, columns={"t": ["c"]})
    assert some("t").schema["c"].dataType == every and some("u").schema["c"].dataType.simpleString() == "string"
    with pytest.raises(ValueError):
        collated(names, columns=["nope"])
    assert binary_text(some("t")).schema["c"].dataType.simpleString() == "string"


def test_the_reports_need_the_collation(spark):
    """The same mixed-case rows without it lose lines."""
    v = ErpViews(spark, SMALL)
    plain = {t: v[t].selectExpr(*c) for t, c in finance._MIXED.items()}
    binary = L.income_expense(plain["tabGL Entry"], plain["tabAccount"], START, END).collect()
    folded = catalog.QUERIES["income_expense_collated"](spark, SMALL).collect()
    assert sum(r["total_income"] or 0 for r in binary) < sum(r["total_income"] or 0 for r in folded)
    # spelling aside, they are those of the untouched tables
    whole = {r["parent_account"].lower(): (r["total_expenses"], r["total_income"])
             for r in catalog.QUERIES["income_expense"](spark, SMALL).collect()}
    assert {r["parent_account"]: (r["total_expenses"], r["total_income"]) for r in folded} == whole
