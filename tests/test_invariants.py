"""Cross-report invariants on the sf0.01 tables."""

import math

import pytest
from pyspark.sql import functions as F

from conftest import MEDIUM
from ledgerlake.plans import catalog

Q = catalog.QUERIES


def run(spark, key):
    return Q[key](spark, MEDIUM)


def test_total_owed_both_forms_agree(spark):
    a = run(spark, "total_owed").first()[0]
    b = run(spark, "total_owed_named").first()[0]
    c = run(spark, "party_balance").where("supplier_balances > 0").agg(F.sum("supplier_balances")).first()[0]
    assert a == b and math.isclose(a, c, rel_tol=1e-12)


def test_ageing_buckets_plus_journal_credits_is_total(spark):
    ageing = {r["supplier_id"]: r for r in run(spark, "payables_ageing").collect()}
    jc = {r["supplier_id"]: r["Outstanding_From_Invoices"] for r in run(spark, "journal_credits").collect()}
    assert ageing
    for sid, r in ageing.items():
        buckets = sum(r[b] for b in ("0-30", "31-60", "61-90", "91-120", "121-Above"))
        assert math.isclose(buckets + (jc.get(sid) or 0.0), r["Total_Outstanding"], rel_tol=1e-9), sid
        assert math.isclose(r["Total_Outstanding"] - r["Unallocated_Amount"], r["Balance"], rel_tol=1e-9, abs_tol=1e-6)
        assert r["Balance"] > 0


def test_month_tracker_ends_at_month_sales(spark):
    tracker = run(spark, "target_tracker").orderBy("posting_date").collect()
    month = run(spark, "p_optional_filter").agg(F.sum("TOTAL_DAILY_SALES")).first()[0]
    assert len(tracker) == 31
    assert math.isclose(tracker[-1]["cumulative_sales"], month, rel_tol=1e-12)
    active = run(spark, "target_tracker_active_days").orderBy("posting_date").collect()
    assert active[-1]["cumulative_sales"] == tracker[-1]["cumulative_sales"]


def test_contribution_percentages_add_up(spark):
    pct = run(spark, "customer_contribution").agg(F.sum("percentage")).first()[0]
    assert math.isclose(pct, 100.0, rel_tol=1e-9)


def test_cash_flow_totals_match_categories(spark):
    flows = run(spark, "cash_flow").groupBy("Cash_Flow_Category").agg(F.sum("amount").alias("a")).collect()
    by = {r[0]: r[1] for r in flows}
    tot = run(spark, "cash_flow_totals").first()
    assert math.isclose(tot["collections"], by.get("Cash From Collections", 0.0), rel_tol=1e-12)
    assert math.isclose(tot["Supplier_payments"], by.get("Cash Outflow", 0.0), rel_tol=1e-12)
    assert math.isclose(tot["other_drawings"], by.get("Other drawings", 0.0), rel_tol=1e-12)
    received = {r[0]: r[1] for r in run(spark, "cash_received").collect()}
    collections = {r[1]: r[2] for r in run(spark, "cash_flow").collect() if r[0] == "Cash From Collections"}
    assert received == collections


def test_net_profit_is_income_minus_expense(spark):
    parts = run(spark, "income_expense").collect()
    net = run(spark, "net_profit").first()["Net_Profit"]
    inc = sum(r["total_income"] or 0.0 for r in parts)
    exp = sum(r["total_expenses"] or 0.0 for r in parts)
    assert math.isclose(net, inc - exp, rel_tol=1e-9)


@pytest.mark.parametrize("key", ["extract_partition", "extract_incremental"])
def test_extract_round_trip_has_no_duplicates(spark, key):
    df = run(spark, key)
    assert df.count() == df.select("o_orderkey").distinct().count() > 0


def test_reports_over_extracted_tables_match_the_oracle(spark):
    """Warehouse mode (bench): the same reports over extracted ERP tables."""
    from conftest import SMALL
    from ledgerlake.sources.extract import scratch_path
    from ledgerlake.sources.fixtures import ERP_TABLES, extract_erp_tables
    from ledgerlake.testing import compare, duck_connection
    root = scratch_path(spark, "t-erp")
    counts = extract_erp_tables(spark, SMALL, root, tables=ERP_TABLES)
    assert counts["tabGL Entry"] > 0
    con = duck_connection(SMALL)
    for key in ("payables_ageing", "cash_flow", "target_tracker", "itemwise_sales", "to_deliver_by_order"):
        rows, problems = compare(Q[key](spark, "erp:" + root), con, catalog.ORACLES[key])
        assert not problems, (key, problems)
