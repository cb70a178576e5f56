"""Physical-plan properties that matter at scale."""

import pytest

from conftest import MEDIUM
from ledgerlake.plans import catalog

Q = catalog.QUERIES


def plan(spark, key) -> str:
    return Q[key](spark, MEDIUM)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", sorted(Q))
def test_no_cartesian_product_or_python(spark, key):
    p = plan(spark, key)
    assert "CartesianProduct" not in p
    assert "PythonUDF" not in p and "ArrowEvalPython" not in p and "BatchEvalPython" not in p


@pytest.mark.parametrize("key", ["customer_contribution", "w_total", "w_share_pct", "j_cross_scalar"])
def test_grand_total_is_a_subquery_not_a_window_or_join(spark, key):
    p = plan(spark, key)
    assert "Window" not in p
    assert "NestedLoopJoin" not in p
    assert "Subquery" in p


@pytest.mark.parametrize("key", ["j_anti", "other_drawings"])
def test_is_null_left_join_is_an_anti_join(spark, key):
    assert "LeftAnti" in plan(spark, key)


def test_month_filter_reaches_the_scan(spark):
    d = Q["p_current_month"](spark, MEDIUM)
    text = d._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate" in text and "LessThan(o_orderdate" in text


def test_scan_reads_only_needed_columns(spark):
    text = Q["daily_sales"](spark, MEDIUM)._jdf.queryExecution().executedPlan().toString()
    schema_line = [ln for ln in text.splitlines() if "orders.parquet" in ln][0]
    assert "o_orderpriority" not in schema_line and "o_orderstatus" not in schema_line


def test_payables_ageing_aggregates_once_per_supplier(spark):
    p = plan(spark, "payables_ageing")
    assert p.count("Union") == 1
    # all credit and debit sources meet in one partial-sum aggregate by supplier
    sums = [ln for ln in p.splitlines() if "HashAggregate(keys=[supplier_id" in ln and "partial_sum(" in ln]
    assert len(sums) == 1


def test_party_names_are_joined_after_aggregation(spark):
    p = Q["party_balance"](spark, MEDIUM)._jdf.queryExecution().optimizedPlan().toString()
    # tree strings print parents first: the lookup join sits above the aggregate
    join_at, agg_at = p.find("Join LeftOuter"), p.find("Aggregate [party")
    assert 0 <= join_at < agg_at
    assert "Join" not in Q["total_owed"](spark, MEDIUM)._jdf.queryExecution().optimizedPlan().toString().split(
        "Aggregate [party")[0]


@pytest.mark.parametrize("key", ["customer_balance", "payables_ageing", "unallocated_payments", "a_representative"])
def test_text_min_runs_on_deduplicated_pairs(spark, key):
    lines = plan(spark, key).splitlines()
    # a MIN over raw rows would be a sort-based aggregate fed by the scan;
    # here every sort-based aggregate reads an already hash-aggregated input
    for i, line in enumerate(lines):
        if "SortAggregate" in line:
            below = next(ln for ln in lines[i + 1:]
                         if not any(op in ln for op in ("Sort [", "Exchange", "SortAggregate", "ShuffleQueryStage")))
            assert "HashAggregate" in below, (line.strip()[:80], below.strip()[:80])


def test_due_date_bound_reaches_the_scan(spark, tmp_path):
    from ledgerlake.operators import ledger as L
    from ledgerlake.sources.fixtures import ErpViews
    ErpViews(spark, MEDIUM).purchase_invoice.write.parquet(str(tmp_path / "pi"))
    limit = spark.conf.get("spark.sql.maxMetadataStringLength")
    spark.conf.set("spark.sql.maxMetadataStringLength", "4000")     # else the filter list is cut off
    try:
        p = L.open_invoices(spark.read.parquet(str(tmp_path / "pi")), "1998-07-10")
        text = p._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.maxMetadataStringLength", limit)
    pushed = [ln for ln in text.splitlines() if "PushedFilters" in ln]
    assert pushed and "LessThanOrEqual(due_date,1998-07-10)" in pushed[0]


@pytest.mark.parametrize("key, join", [("cash_flow", "Join LeftOuter"), ("cash_flow_totals", "Join LeftOuter"),
                                       ("other_drawings", "Join LeftAnti"), ("cash_received", "Join LeftSemi")])
def test_cash_is_summed_before_the_counterparty_lookups(spark, key, join):
    # With a broadcast lookup no line is exchanged by counterparty (and Spark may test the lines
    # first); the hot counterparty matters where the lookup is too large for that.
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = Q[key](spark, MEDIUM)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    # tree strings print parents first: below every lookup join there is an aggregate by counterparty
    joins = [i for i, ln in enumerate(p) if join in ln and "against" in ln]
    assert joins
    assert all(any("Aggregate [against" in ln for ln in p[i:]) for i in joins)


def test_to_deliver_reads_order_lines_once(spark):
    p = plan(spark, "to_deliver_by_order")
    assert p.count("lineitem.parquet") == 1        # detail and total share one aggregation
    assert "Expand" in p
