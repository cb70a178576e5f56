"""Reports on hand-made edge tables (FIXTURES.md section 5)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerlake.operators import ledger as L
from ledgerlake.operators import sales as S

D = dt.date
AS_OF = D(1998, 7, 10)

ACCOUNT_DDL = "name string, account_type string, parent_account string, root_type string"
ACCOUNTS = [("Creditors", "Payable", "2100 - Accounts Payable", "Liability"),
            ("Salaries Payable", "Payable", "2500 - Payroll Liabilities - NML", "Liability"),
            ("Staff Payable", "Payable", "2600 - Payroll Other", "Liability"),
            ("Bank KES", "Bank", "1100 - Bank", "Asset"), ("Petty Cash", "Cash", "1000 - Cash", "Asset"),
            ("Suspense Account NML", "Bank", "1100 - Bank", "Asset"),
            ("Sales", "Income Account", "4000 - Income", "Income"),
            ("Rent", "Expense Account", "6000 - Indirect Expenses", "Expense")]


@pytest.fixture(scope="module")
def account(spark):
    return spark.createDataFrame(ACCOUNTS, ACCOUNT_DDL)


@pytest.fixture(scope="module")
def supplier(spark):
    return spark.createDataFrame([("SUP-A", "Alpha"), ("SUP-B", "Beta"), ("SUP-C", "Gamma"), ("SUP-D", "Delta"),
                                  ("SUP-P", "Payroll Co"), ("SUP-N", None)], "name string, supplier_name string")


def test_payables_ageing_edges(spark, account, supplier):
    pi = spark.createDataFrame([
        ("SUP-A", "Alpha", AS_OF - dt.timedelta(10), 100.0, "KES", 1.0, 1, "Unpaid"),
        ("SUP-A", "Alpha", AS_OF - dt.timedelta(45), 50.0, "KES", 1.0, 1, "Overdue"),
        ("SUP-A", "Alpha", AS_OF + dt.timedelta(5), 70.0, "KES", 1.0, 1, "Unpaid"),      # not due yet
        ("SUP-A", "Alpha", AS_OF - dt.timedelta(5), 90.0, "KES", 1.0, 1, "Paid"),        # settled
        ("SUP-A", "Alpha", AS_OF - dt.timedelta(5), 90.0, "KES", 1.0, 2, "Unpaid"),      # cancelled
        ("SUP-A", "Alpha", AS_OF - dt.timedelta(121), 10.0, "USD", 130.0, 1, None),      # NULL status: NOT IN drops it
        ("SUP-C", "Gamma", AS_OF - dt.timedelta(0), 20.0, "KES", 1.0, 1, "Unpaid"),
        ("SUP-D", "Delta", AS_OF - dt.timedelta(121), 10.0, "USD", 130.0, 1, "Unpaid"),
        (None, None, AS_OF - dt.timedelta(61), 10.0, "KES", 1.0, 1, "Unpaid"),
    ], "supplier string, supplier_name string, due_date date, outstanding_amount double, party_account_currency string, "
       "conversion_rate double, docstatus int, status string")
    je = spark.createDataFrame([("JE-1", 1, 0), ("JE-2", 1, 1), ("JE-3", 2, 0)],
                               "name string, docstatus int, is_system_generated int")
    jea = spark.createDataFrame([
        ("JE-1", "SUP-D", "Supplier", "Creditors", 0.0, 500.0, None, None, 1),           # credit
        ("JE-1", "SUP-D", "Supplier", "Creditors", 100.0, 0.0, "Journal Entry", "X", 1),  # allocated debit
        ("JE-1", "SUP-D", "Supplier", "Creditors", 10.0, 0.0, "Purchase Invoice", "Y", 1),  # excluded
        ("JE-1", "SUP-D", "Supplier", "Bank KES", 0.0, 999.0, None, None, 1),            # not payable
        ("JE-2", "SUP-D", "Supplier", "Creditors", 0.0, 999.0, None, None, 1),           # system generated
        ("JE-3", "SUP-D", "Supplier", "Creditors", 0.0, 999.0, None, None, 1),           # cancelled parent
        ("JE-1", "SUP-D", "Supplier", "Creditors", 0.0, 999.0, None, "Z", 1),            # has a reference name
    ], "parent string, party string, party_type string, account string, debit double, credit double, "
       "reference_type string, reference_name string, docstatus int")
    jea = jea.withColumn("name", F.concat(F.lit("JEA-"), F.monotonically_increasing_id().cast("string")))
    pe = spark.createDataFrame([
        ("PE-1", "SUP-A", "Supplier", "Alpha", "Pay", 1, 30.0, 0.0),
        ("PE-2", "SUP-B", "Supplier", "Beta", "Pay", 1, 40.0, 0.0),      # debits only: not listed
        ("PE-3", "SUP-C", "Supplier", "Gamma", "Pay", 1, 20.0, 0.0),     # zero balance
        ("PE-4", None, "Supplier", None, "Pay", 1, 5.0, 0.0),            # NULL party never matches
        ("PE-5", "SUP-A", "Supplier", "Alpha", "Receive", 1, 1000.0, 0.0),
    ], "name string, party string, party_type string, party_name string, payment_type string, docstatus int, "
       "base_paid_amount double, base_total_allocated_amount double")
    per = spark.createDataFrame([("PE-1", "Journal Entry", 0.0)], "parent string, reference_doctype string, allocated_amount double")
    out = L.payables_ageing(pi, jea, je, account, supplier, pe, per, AS_OF).collect()
    rows = {r["supplier_id"]: r.asDict() for r in out}
    assert set(rows) == {"SUP-A", "SUP-D", None}
    a = rows["SUP-A"]
    assert (a["0-30"], a["31-60"], a["Total_Outstanding"], a["Unallocated_Amount"], a["Balance"]) == (100.0, 50.0, 150.0, 30.0, 120.0)
    d = rows["SUP-D"]
    assert d["121-Above"] == 1300.0 and d["Total_Outstanding"] == 1800.0 and d["Unallocated_Amount"] == 100.0
    assert d["Balance"] == 1700.0 and d["supplier_name"] == "Delta"
    n = rows[None]
    assert n["61-90"] == 10.0 and n["Unallocated_Amount"] == 0.0 and n["Balance"] == 10.0
    assert [r["supplier_id"] for r in out] == ["SUP-D", "SUP-A", None]   # largest balance first


def test_target_tracker_leap_month_last_day(spark):
    si = spark.createDataFrame([(D(2024, 2, 10), 1000.0, 1), (D(2024, 2, 10), 5.0, 2), (D(2024, 3, 1), 9.0, 1)],
                               "posting_date date, base_grand_total double, docstatus int")
    t = {r["posting_date"]: r for r in S.target_tracker(si, D(2024, 2, 29)).collect()}
    assert len(t) == 29
    target = 135_000_000 / 29
    last = t[D(2024, 2, 29)]
    assert last["cumulative_sales"] == 1000.0
    assert last["new_daily_sales_target"] is None            # no days left: NULL, not an error
    assert last["spread_per_day"] == last["cumulative_deficit"]  # GREATEST(0, 1)
    mid = {r["posting_date"]: r for r in S.target_tracker(si, D(2024, 2, 10)).collect()}
    deficit10 = mid[D(2024, 2, 10)]["cumulative_deficit"]
    assert mid[D(2024, 2, 9)]["new_daily_sales_target"] is None
    assert mid[D(2024, 2, 20)]["new_daily_sales_target"] == target + deficit10 / 19
    active = S.target_tracker_active_days(si, D(2024, 2, 29)).collect()
    assert len(active) == 1 and active[0]["sales_target_cumulative"] == target


def test_target_tracker_month_without_sales(spark):
    si = spark.createDataFrame([(D(2024, 3, 1), 9.0, 1)], "posting_date date, base_grand_total double, docstatus int")
    t = S.target_tracker(si, D(2024, 2, 15)).collect()
    assert len(t) == 29 and all(r["sales_today"] == 0.0 for r in t)


def test_customer_contribution_filters(spark):
    si = spark.createDataFrame([
        ("C1", "One", D(1998, 7, 2), 100.0, 1, "No", "Paid"),
        ("C1", "One", D(1998, 7, 3), 100.0, 1, "No", "Unpaid"),
        ("C2", "Two", D(1998, 7, 3), 200.0, 1, "No", "Paid"),
        ("C2", "Two", D(1998, 7, 3), 999.0, 1, "No", "Return"),
        ("C2", "Two", D(1998, 7, 3), 999.0, 1, "No", None),        # NULL status dropped by NOT IN
        ("C3", "Three", D(1998, 7, 3), 999.0, 1, "Yes", "Paid"),    # opening
        ("C3", "Three", D(1998, 7, 3), 999.0, 2, "No", "Paid"),     # cancelled
        ("C3", "Three", D(1998, 8, 1), 999.0, 1, "No", "Paid"),     # outside the period
    ], "customer string, customer_name string, posting_date date, base_grand_total double, docstatus int, "
       "is_opening string, status string")
    out = S.customer_contribution(si, D(1998, 7, 1), D(1998, 7, 31)).collect()
    assert [(r["customer"], r["total_sales_per"], r["percentage"]) for r in out] == [("C2", 200.0, 50.0), ("C1", 200.0, 50.0)] \
        or [(r["customer"], r["total_sales_per"], r["percentage"]) for r in out] == [("C1", 200.0, 50.0), ("C2", 200.0, 50.0)]
    assert all(r["total_sales_revenue"] == 400.0 for r in out)
    with_opening = S.customer_contribution(si, D(1998, 7, 1), D(1998, 7, 31), exclude_opening=False).collect()
    assert {r["customer"] for r in with_opening} == {"C1", "C2", "C3"}


def test_itemwise_tax_and_team_fanout(spark):
    si = spark.createDataFrame([
        ("SI-1", "C1", "One", D(1998, 7, 1), D(1998, 7, 31), 1, "No", 0.0, 0.0),
        ("SI-2", "C2", "Two", D(1998, 7, 1), D(1998, 7, 31), 1, "No", 16.0, 0.0),
        ("SI-3", "C3", "Three", D(1998, 7, 1), D(1998, 7, 31), 1, "No", None, 4.0),
        ("SI-4", "C1", "One", D(1998, 7, 1), D(1998, 7, 31), 1, "No", 8.0, 4.0),
    ], "name string, customer string, customer_name string, posting_date date, due_date date, docstatus int, "
       "is_opening string, base_total_taxes_and_charges double, total_qty double")
    for c in ("export_series", "etr_invoice_number", "tax_category", "status", "tax_id"):
        si = si.withColumn(c, F.lit("x"))
    sii = spark.createDataFrame([("SI-1", None, "I", "Item", 2.0, 10.0, 20.0, 0.05), ("SI-2", "DN-2", "I", "Item", 2.0, 10.0, 20.0, 0.05),
                                 ("SI-3", None, "I", "Item", 4.0, 10.0, 40.0, 0.1), ("SI-4", None, "I", "Item", 4.0, 10.0, 40.0, 0.1)],
                                "parent string, delivery_note string, item_code string, item_name string, qty double, "
                                "base_rate double, base_amount double, tonnes_input double")
    dn = spark.createDataFrame([("DN-2", "", None, "KCC-300")], "name string, company_vehicle string, "
                               "customer_provided_vehicle string, transporter_vehicle_number string")
    team = spark.createDataFrame([("C1", "Ann"), ("C1", "Bob"), ("C3", "Cy")], "parent string, sales_person string")
    out = S.itemwise_sales(sii, si, dn, team).collect()
    by_inv = {}
    for r in out:
        by_inv.setdefault(r["sales_invoice_id"], []).append(r)
    assert len(by_inv["SI-1"]) == 2 and len(by_inv["SI-4"]) == 2       # two sales persons
    assert by_inv["SI-2"][0]["sales_person_name"] is None                # none: kept once
    assert by_inv["SI-1"][0]["tax_per_item"] == 0.0                      # no tax
    assert by_inv["SI-2"][0]["tax_per_item"] is None                     # tax but zero quantity
    assert by_inv["SI-3"][0]["tax_per_item"] == 0.0                      # NULL tax falls to ELSE 0
    assert by_inv["SI-4"][0]["rate_after_tax"] == 12.0 and by_inv["SI-4"][0]["amount_after_tax"] == 48.0
    assert by_inv["SI-2"][0]["vehicle_number"] == "KCC-300"


def test_open_order_lines_rules(spark):
    so = spark.createDataFrame([
        ("SO-1", dt.datetime(1998, 7, 3), D(1998, 7, 3), D(1998, 7, 17), "A", 1, 60.0, "To Deliver", "KES", 1.0),
        ("SO-2", dt.datetime(1998, 7, 2), D(1998, 7, 2), D(1998, 7, 16), "B", 1, 0.0, "To Deliver", "KES", 1.0),  # 8 days
        ("SO-3", dt.datetime(1998, 7, 9), D(1998, 7, 9), D(1998, 7, 23), "C", 1, 80.0, "To Deliver", "KES", 1.0),  # 80 %
        ("SO-4", dt.datetime(1998, 7, 9), D(1998, 7, 9), D(1998, 7, 23), "D", 1, 0.0, None, "KES", 1.0),          # NULL status
        ("SO-5", dt.datetime(1998, 7, 9), D(1998, 7, 9), D(1998, 7, 23), "E", 1, 0.0, "On Hold", "KES", 1.0),
        ("SO-6", dt.datetime(1998, 7, 9), D(1998, 7, 9), D(1998, 7, 23), "F", 1, 0.0, "To Deliver", "USD", 130.0),
    ], "name string, creation timestamp_ntz, transaction_date date, delivery_date date, customer_name string, docstatus int, "
       "per_delivered double, status string, currency string, conversion_rate double")
    soi = spark.createDataFrame([
        ("SO-1", "I1", "Item 1", 0.025, 1000.0, 0.0, 10.0, "Kenya Tax - NML"),
        ("SO-1", "SRV-001", "Transport", 0.025, 10.0, 0.0, 10.0, None),
        ("SO-1", "I2", "Item 2", 0.05, 10.0, 10.0, 10.0, None),     # nothing left
        ("SO-2", "I1", "Item 1", 0.025, 10.0, 0.0, 10.0, None),
        ("SO-3", "I1", "Item 1", 0.025, 10.0, 0.0, 10.0, None),
        ("SO-4", "I1", "Item 1", 0.025, 10.0, 0.0, 10.0, None),
        ("SO-5", "I1", "Item 1", 0.025, 10.0, 0.0, 10.0, None),
        ("SO-6", "I1", "Item 1", 0.05, 600.0, 0.0, 2.0, None),
    ], "parent string, item_code string, item_name string, weight_per_unit double, qty double, delivered_qty double, "
       "rate double, item_tax_template string")
    team = spark.createDataFrame([("SO-6", "P1"), ("SO-6", "P2")], "parent string, sales_person string")
    rows = S.open_order_lines(so, soi, team, AS_OF, 7).collect()
    got = sorted((r["sales_order_id"], r["item_code"], r["sales_person"], r["quantity_in_tonnes"], r["product_amount"]) for r in rows)
    assert got == [("SO-1", "I1", None, 0.025 * 680, 680 * 11.6),
                   ("SO-6", "I1", "P1", 0.05 * 560, 560 * 260.0), ("SO-6", "I1", "P2", 0.05 * 560, 560 * 260.0)]


def test_cash_flow_payroll_fanout_and_drawings(spark, account, supplier):
    gl = spark.createDataFrame([
        ("Bank KES", "SUP-P", 0.0, 100.0, "Pay"),              # 2 payroll accounts: counted twice
        ("Bank KES", "SUP-A", 0.0, 50.0, "Journal Entry"),
        ("Bank KES", "CUST-1", 70.0, 0.0, "Receive"),
        ("Petty Cash", "CUST-1", 5.0, 0.0, "Journal Entry"),
        ("Suspense Account NML", "CUST-1", 999.0, 0.0, "Receive"),
        ("Bank KES", "Rent", 0.0, 30.0, "Pay"),                 # drawing
        ("Bank KES", "Rent", 0.0, 999.0, "Internal Transfer"),
        ("Bank KES", "Rent", 0.0, 999.0, None),                 # NULL subtype: NOT IN drops it
        ("Bank KES", "04003101171250 I&M BANK KES A/C - NML", 0.0, 999.0, "Pay"),
        ("Bank KES", "SUP-N", 0.0, 7.0, "Pay"),                 # unnamed supplier: a payment and a drawing
    ], "account string, against string, debit double, credit double, voucher_subtype string")
    gl = (gl.withColumn("posting_date", F.lit(D(1998, 7, 5))).withColumn("is_cancelled", F.lit(0))
          .withColumn("party_type", F.lit(None).cast("string")).withColumn("voucher_type", F.lit("Payment Entry"))
          .withColumn("voucher_no", F.lit("V")).withColumn("against_voucher_type", F.lit(None).cast("string"))
          .withColumn("against_voucher", F.lit(None).cast("string")))
    customer = spark.createDataFrame([("CUST-1", "Cust")], "name string, customer_name string")
    pa = spark.createDataFrame([("SUP-P", "Salaries Payable"), ("SUP-P", "Staff Payable"), ("SUP-A", "Creditors")],
                               "parent string, account string")
    args = (gl, account, customer, supplier, pa, D(1998, 7, 1), D(1998, 7, 31))
    flow = {(r[0], r[1]): r[2] for r in L.cash_flow(*args).collect()}
    assert flow == {("Cash From Collections", "Bank KES"): 70.0, ("Cash From Collections", "Petty Cash"): 5.0,
                    ("Cash Outflow", "Salary Payment"): 100.0, ("Cash Outflow", "Supplier Payment"): 157.0,
                    ("Other drawings", "Rent"): 30.0, ("Other drawings", "SUP-N"): 7.0}
    tot = L.cash_flow_totals(*args).collect()
    assert [tuple(r) for r in tot] == [("Balance/Deficit", 75.0, 257.0, 37.0)]
    empty = L.cash_flow_totals(gl.where("false"), *args[1:]).collect()
    assert empty == []                                           # GROUP BY a constant: no row


def test_net_profit_nulls(spark, account):
    base = "account string, debit double, credit double"
    def run(rows):
        gl = spark.createDataFrame(rows, base).withColumn("posting_date", F.lit(D(1998, 7, 5))).withColumn("is_cancelled", F.lit(0))
        return L.net_profit(gl, account, D(1998, 7, 1), D(1998, 7, 31), "CO-1").first()
    both = run([("Sales", 0.0, 100.0), ("Rent", 30.0, 0.0)])
    assert both["Net_Profit"] == 70.0 and both["company"] == "CO-1" and both["Account_type"] == ""
    assert run([("Rent", 30.0, 0.0)])["Net_Profit"] is None       # no income row at all
    empty = run([("Bank KES", 1.0, 0.0)])
    assert empty["Net_Profit"] is None and empty["company"] is None


def test_party_balance_two_currencies(spark):
    gl = spark.createDataFrame([("CUST-33", "KES", 10.0, 0.0, 0), ("CUST-33", "USD", 5.0, 1.0, 0), ("CUST-33", "USD", 99.0, 0.0, 1),
                                (None, "KES", 1.0, 0.0, 0)],
                               "party string, transaction_currency string, debit_in_transaction_currency double, "
                               "credit_in_transaction_currency double, is_cancelled int")
    one = L.party_currency_balance(gl, party="CUST-33").collect()
    assert [tuple(r) for r in one] == [("CUST-33", "KES", 14.0)]
    by = sorted(tuple(r) for r in L.party_currency_balance(gl, party="CUST-33", by_currency=True).collect())
    assert by == [("CUST-33", "KES", 10.0), ("CUST-33", "USD", 4.0)]


def test_to_deliver_with_no_open_lines_keeps_the_total_row(spark):
    so = spark.createDataFrame([("SO-1", dt.datetime(1990, 1, 1), D(1990, 1, 1), D(1990, 1, 15), "A", 1, 0.0, "x", "KES", 1.0)],
                               "name string, creation timestamp_ntz, transaction_date date, delivery_date date, "
                               "customer_name string, docstatus int, per_delivered double, status string, currency string, "
                               "conversion_rate double")
    soi = spark.createDataFrame([("SO-1", "I1", "Item", 0.025, 10.0, 0.0, 1.0, None)],
                                "parent string, item_code string, item_name string, weight_per_unit double, qty double, "
                                "delivered_qty double, rate double, item_tax_template string")
    team = spark.createDataFrame([], "parent string, sales_person string")
    si = spark.createDataFrame([("C1", "CO-1", AS_OF, 1, 50.0)],
                               "customer string, company string, posting_date date, docstatus int, base_grand_total double")
    company = spark.createDataFrame([("CO-1",)], "name string")
    customer = spark.createDataFrame([("C1", "One")], "name string, customer_name string")
    out = [tuple(r) for r in S.to_deliver_by_customer(so, soi, team, si, company, customer, AS_OF).collect()]
    assert out == [("Potential Deliveries", "", "", "", None, None), ("Sales Today", "", "", "", None, 50.0),
                   ("Sales Target", "", "", "", None, 135_000_000 / 31)]
    by_order = S.to_deliver_by_order(so, soi, team, si, company, customer, AS_OF).collect()
    assert [r["sales_order_id"] for r in by_order] == ["TOTALS", "Sales Today", "Sales Target Today"]


def test_journal_line_classes(spark, account):
    je = spark.createDataFrame([("JE-1", 1, 0), ("JE-2", 1, 1)], "name string, docstatus int, is_system_generated int")
    jea = spark.createDataFrame([
        ("a", "JE-1", "SUP-A", "Supplier", "Creditors", 0.0, 10.0, None, None, 1),             # credit, no reference
        ("b", "JE-1", "SUP-A", "Supplier", "Creditors", 0.0, 10.0, None, "R", 1),              # credit with a name only
        ("c", "JE-1", "SUP-A", "Supplier", "Creditors", 5.0, 0.0, None, "R", 1),               # debit, no type: open
        ("d", "JE-1", "SUP-A", "Supplier", "Creditors", 5.0, 0.0, "Journal Entry", "R", 1),    # debit allocated
        ("e", "JE-1", "SUP-A", "Supplier", "Creditors", 5.0, 0.0, "Purchase Invoice", "R", 1), # debit to invoice
        ("f", "JE-2", "SUP-A", "Supplier", "Creditors", 0.0, 10.0, None, None, 1),             # system made
        ("g", "JE-1", "SUP-A", "Customer", "Creditors", 0.0, 10.0, None, None, 1),             # other party type
        ("h", "JE-1", "SUP-A", "Supplier", "Bank KES", 0.0, 10.0, None, None, 1),              # not payable
        ("i", "JE-1", "SUP-A", "Supplier", "Creditors", 3.0, 4.0, None, None, 1),              # both sides
    ], "name string, parent string, party string, party_type string, account string, debit double, credit double, "
       "reference_type string, reference_name string, docstatus int")
    rows = {r["name"]: (r["is_credit"], r["is_debit_open"], r["is_debit_alloc"])
            for r in L.journal_payable_lines(jea, je, account).collect()}
    assert rows == {"a": (True, False, False), "b": (False, False, False), "c": (False, True, False),
                    "d": (False, False, True), "e": (False, False, False), "i": (True, True, False)}
