"""Operator-level queries.

Each key exercises one primitive or ERP operator of the library on whole
ERP tables, with an independent DuckDB statement as its oracle.
"""

from __future__ import annotations

import calendar as _calendar
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DoubleType, StringType, StructField, StructType

from ledgerlake import functions as fn
from ledgerlake.functions.dates import as_date
from ledgerlake.functions.erp import line_tonnes, line_value
from ledgerlake.operators import ledger as L
from ledgerlake.operators import sales as S
from ledgerlake.operators.relational import (
    attach_scalar,
    detail_and_total,
    group_by_constant,
    labelled_row,
    sums_with_min_text,
    union_positional,
)
from ledgerlake.operators.series import running_sums, running_total
from ledgerlake.plans.registry import AS_OF, END, MONTHLY_TARGET, START, dsum, msum, register, sql_date
from ledgerlake.sources.fixtures import ErpViews

_PERIOD = f"BETWEEN {sql_date(START)} AND {sql_date(END)}"
_BUCKETS = [b[0] for b in L.AGEING_BUCKETS]


def q(key: str, sql: str | None):
    """Register ``fn(views) -> DataFrame`` under ``key``."""
    def deco(f):
        register(key, sql)(lambda spark, sf_dir, _f=f: _f(ErpViews(spark, sf_dir)))
        return f
    return deco


def _d(c):
    return fn.as_double(c)


# ---------------------------------------------------------------- 2.2 P1-P19

@q("p_select", """SELECT name AS gl_entry_id, posting_date, account, party_type, party, debit, credit FROM "tabGL Entry" """)
def p_select(v):
    return v.gl_entry.select(F.col("name").alias("gl_entry_id"), "posting_date", "account", "party_type", "party",
                             "debit", "credit")


@q("p_literals", f"""SELECT name, 'Potential Deliveries' AS label, '' AS filler, {MONTHLY_TARGET} AS monthly_target,
  {", ".join(f'0 AS "{b}"' for b in _BUCKETS)} FROM "tabSales Invoice" """)
def p_literals(v):
    return v.sales_invoice.select("name", F.lit("Potential Deliveries").alias("label"), F.lit("").alias("filler"),
                                  F.lit(MONTHLY_TARGET).alias("monthly_target"), *[F.lit(0).alias(b) for b in _BUCKETS])


@q("p_arithmetic", """SELECT parent, item_code, qty - delivered_qty AS qty_to_deliver, qty * weight_per_unit AS weight_in_tonnes,
  rate * -1 AS negated_rate, rate / NULLIF(qty, 0) AS rate_per_bag FROM "tabSales Order Item" """)
def p_arithmetic(v):
    t = v.sales_order_item
    return t.select("parent", "item_code", (F.col("qty") - F.col("delivered_qty")).alias("qty_to_deliver"),
                    (F.col("qty") * F.col("weight_per_unit")).alias("weight_in_tonnes"),
                    (F.col("rate") * F.lit(-1)).alias("negated_rate"), fn.safe_divide("rate", "qty").alias("rate_per_bag"))


@q("p_filter_eq", """SELECT name, customer, base_grand_total FROM "tabSales Invoice" WHERE docstatus = 1 AND is_opening = 'No'""")
def p_filter_eq(v):
    return v.sales_invoice.where((F.col("docstatus") == 1) & (F.col("is_opening") == "No")).select(
        "name", "customer", "base_grand_total")


@q("p_filter_ne", """SELECT name, party, reference_type, debit FROM "tabJournal Entry Account" WHERE reference_type <> 'Purchase Invoice'""")
def p_filter_ne(v):
    return v.journal_entry_account.where(F.col("reference_type") != "Purchase Invoice").select(
        "name", "party", "reference_type", "debit")


@q("p_filter_cmp", """SELECT name, per_delivered, per_billed FROM "tabSales Order" WHERE per_delivered <= 60 AND per_billed > 0""")
def p_filter_cmp(v):
    return v.sales_order.where((F.col("per_delivered") <= 60) & (F.col("per_billed") > 0)).select(
        "name", "per_delivered", "per_billed")


@q("p_between", f"""SELECT name, party, posting_date, credit FROM "tabGL Entry" WHERE posting_date {_PERIOD}""")
def p_between(v):
    return v.gl_entry.where(fn.date_in_period("posting_date", START, END)).select("name", "party", "posting_date", "credit")


@q("p_in", """SELECT name, account, voucher_subtype, debit FROM "tabGL Entry" WHERE voucher_subtype IN ('Journal Entry', 'Receive')""")
def p_in(v):
    return v.gl_entry.where(F.col("voucher_subtype").isin(*L.COLLECTION_SUBTYPES)).select(
        "name", "account", "voucher_subtype", "debit")


@q("p_not_in", """SELECT name, status, base_grand_total FROM "tabSales Invoice" WHERE status NOT IN ('Return')""")
def p_not_in(v):
    return v.sales_invoice.where(~F.col("status").isin("Return")).select("name", "status", "base_grand_total")


@q("p_null_tests", """SELECT name, reference_type IS NULL AS no_reference_type, reference_name IS NOT NULL AS has_reference_name,
  party_type IS NULL AS no_party_type FROM "tabJournal Entry Account" """)
def p_null_tests(v):
    return v.journal_entry_account.select("name", F.col("reference_type").isNull().alias("no_reference_type"),
                                          F.col("reference_name").isNotNull().alias("has_reference_name"),
                                          F.col("party_type").isNull().alias("no_party_type"))


@q("p_like", """SELECT name, against, credit FROM "tabGL Entry" WHERE against LIKE '%BANK%'""")
def p_like(v):
    return v.gl_entry.where(F.col("against").like("%BANK%")).select("name", "against", "credit")


@q("p_filter_expr", """SELECT parent, item_code, qty, delivered_qty FROM "tabSales Order Item" WHERE qty - delivered_qty > 0""")
def p_filter_expr(v):
    return v.sales_order_item.where((F.col("qty") - F.col("delivered_qty")) > 0).select(
        "parent", "item_code", "qty", "delivered_qty")


_PAYABLE_PARTIES = f"""payable_parties AS (
  SELECT gl.party, {msum('gl.credit')} AS cr, {msum('gl.debit')} AS dr
  FROM "tabGL Entry" gl JOIN "tabAccount" a ON gl.account = a.name
  WHERE gl.is_cancelled = 0 AND a.account_type = 'Payable' GROUP BY gl.party)"""


@q("p_having", f"""WITH {_PAYABLE_PARTIES} SELECT party, CAST(cr - dr AS DOUBLE) AS balance FROM payable_parties WHERE cr - dr > 0""")
def p_having(v):
    b = L.party_balance(v.gl_entry, v.account, v.supplier)
    return b.where(F.col("supplier_balances") > 0).select("party", _d("supplier_balances").alias("balance"))


_MS = AS_OF.replace(day=1)
_ME = AS_OF.replace(day=_calendar.monthrange(AS_OF.year, AS_OF.month)[1])


@q("p_current_month", f"""SELECT name, posting_date, base_grand_total FROM "tabSales Invoice"
  WHERE docstatus = 1 AND posting_date BETWEEN {sql_date(_MS)} AND {sql_date(_ME)}""")
def p_current_month(v):
    return (S.submitted(v.sales_invoice)
            .where(fn.date_in_period("posting_date", fn.month_start(AS_OF), fn.month_end(AS_OF)))
            .select("name", "posting_date", "base_grand_total"))


@q("p_last_n_days", f"""SELECT name, transaction_date FROM "tabSales Order"
  WHERE transaction_date >= {sql_date(AS_OF)} - 7""")
def p_last_n_days(v):
    return v.sales_order.where(fn.last_n_days("transaction_date", AS_OF, 7)).select("name", "transaction_date")


@q("p_optional_filter", f"""SELECT posting_date, {dsum('base_grand_total')} AS TOTAL_DAILY_SALES FROM "tabSales Invoice"
  WHERE docstatus = 1 AND posting_date {_PERIOD} GROUP BY posting_date""")
def p_optional_filter(v):
    return S.daily_sales(v.sales_invoice, where=fn.date_in_period("posting_date", START, END))


@q("p_params", f"""SELECT name, posting_date, base_grand_total FROM "tabSales Invoice" WHERE docstatus = 1 AND posting_date {_PERIOD}""")
def p_params(v):
    return v.spark.sql(
        "SELECT name, posting_date, base_grand_total FROM {si} "
        "WHERE docstatus = :status AND posting_date BETWEEN :start AND :end",
        args={"status": 1, "start": START, "end": END}, si=v.sales_invoice)


@q("p_doc_state", """SELECT name, party, debit, credit FROM "tabGL Entry" WHERE docstatus = 1 AND is_cancelled = 0""")
def p_doc_state(v):
    return L.submitted(L.not_cancelled(v.gl_entry)).select("name", "party", "debit", "credit")


# ---------------------------------------------------------------- 2.3 J1-J13

@q("j_inner_dim", """SELECT gl.name, gl.party, gl.account, acc.account_type, gl.credit
FROM "tabGL Entry" gl JOIN "tabAccount" acc ON gl.account = acc.name WHERE acc.account_type = 'Payable'""")
def j_inner_dim(v):
    acc = L.accounts_of_type(v.account, "Payable").select(F.col("name").alias("account"), "account_type")
    return v.gl_entry.join(acc, "account", "inner").select("name", "party", "account", "account_type", "credit")


@q("j_parent_child", """SELECT jea.name, je.posting_date, jea.party, jea.debit, jea.credit
FROM "tabJournal Entry Account" jea JOIN "tabJournal Entry" je ON jea.parent = je.name""")
def j_parent_child(v):
    je = v.journal_entry.select(F.col("name").alias("parent"), "posting_date")
    return v.journal_entry_account.join(je, "parent", "inner").select("name", "posting_date", "party", "debit", "credit")


@q("j_counterparty", """SELECT gl.name, gl.against, cu.customer_name, gl.debit
FROM "tabGL Entry" gl JOIN "tabCustomer" cu ON gl.against = cu.name""")
def j_counterparty(v):
    cu = v.customer.select(F.col("name").alias("against"), "customer_name")
    return v.gl_entry.join(cu, "against", "inner").select("name", "against", "customer_name", "debit")


@q("j_semi", """SELECT si.name, si.customer, si.base_grand_total FROM "tabSales Invoice" si
JOIN "tabCompany" co ON si.company = co.name JOIN "tabCustomer" cu ON si.customer = cu.name""")
def j_semi(v):
    return (v.sales_invoice
            .join(v.company.select(F.col("name").alias("company")), "company", "left_semi")
            .join(v.customer.select(F.col("name").alias("customer")), "customer", "left_semi")
            .select("name", "customer", "base_grand_total"))


@q("j_left_lookup", """SELECT gl.name, gl.party, sp.supplier_name FROM "tabGL Entry" gl LEFT JOIN "tabSupplier" sp ON gl.party = sp.name""")
def j_left_lookup(v):
    return L.with_supplier_name(v.gl_entry.select("name", "party"), v.supplier).select("name", "party", "supplier_name")


@q("j_outer_to_inner", """SELECT sii.parent, sii.item_code, si.customer, si.posting_date
FROM "tabSales Invoice Item" sii LEFT JOIN "tabSales Invoice" si ON sii.parent = si.name WHERE si.docstatus = 1""")
def j_outer_to_inner(v):
    si = S.submitted(v.sales_invoice).select(F.col("name").alias("parent"), "customer", "posting_date")
    return v.sales_invoice_item.join(si, "parent", "inner").select("parent", "item_code", "customer", "posting_date")


@q("j_unused_left", """SELECT pi.name, pi.supplier, pi.outstanding_amount
FROM "tabPurchase Invoice" pi LEFT JOIN "tabSupplier" su ON pi.supplier = su.name WHERE pi.docstatus = 1""")
def j_unused_left(v):
    # the supplier join adds no column and ``name`` is unique: left out
    return L.submitted(v.purchase_invoice).select("name", "supplier", "outstanding_amount")


@q("j_fanout", """SELECT so.name, so.customer_name, st.sales_person
FROM "tabSales Order" so LEFT JOIN "tabSales Team" st ON so.name = st.parent""")
def j_fanout(v):
    st = v.sales_team.select(F.col("parent").alias("name"), "sales_person")
    return v.sales_order.join(st, "name", "left").select("name", "customer_name", "sales_person")


@q("j_fanout_deduped", """SELECT so.name, so.customer_name, st.sales_person
FROM "tabSales Order" so LEFT JOIN (SELECT parent, MIN(sales_person) AS sales_person FROM "tabSales Team" GROUP BY parent) st ON so.name = st.parent""")
def j_fanout_deduped(v):
    st = S.one_person(v.sales_team).withColumnRenamed("parent", "name")
    return v.sales_order.join(st, "name", "left").select("name", "customer_name", "sales_person")


# Equal shares by largest remainder: whole cents, the first persons by name take what is left over.
@q("j_fanout_allocated", """WITH team AS (
  SELECT parent, sales_person, ROW_NUMBER() OVER (PARTITION BY parent ORDER BY sales_person) AS place, COUNT(*) OVER (PARTITION BY parent) AS n
  FROM (SELECT DISTINCT parent, sales_person FROM "tabSales Team") t),
lines AS (SELECT parent, CAST(qty * rate * 100 AS BIGINT) AS units FROM "tabSales Order Item")
SELECT sales_person, CAST(SUM(CASE WHEN n IS NULL THEN units WHEN place <= units % n THEN units // n + 1 ELSE units // n END) AS DOUBLE) / 100 AS amount,
  COUNT(*) AS lines
FROM lines LEFT JOIN team ON lines.parent = team.parent GROUP BY sales_person""")
def j_fanout_allocated(v):
    lines = v.sales_order_item.select("parent", (F.col("qty") * F.col("rate")).alias("value"))
    shared = S.allocate(lines.withColumnRenamed("parent", "document"), v.sales_team, "document", "value")
    return shared.groupBy("sales_person").agg(_d(F.sum("allocated")).alias("amount"), F.count(F.lit(1)).alias("lines"))


@q("j_anti", """SELECT gl.name, gl.against, gl.credit FROM "tabGL Entry" gl LEFT JOIN "tabSupplier" sp ON gl.against = sp.name
WHERE sp.supplier_name IS NULL AND gl.credit > 0""")
def j_anti(v):
    named = v.supplier.where(F.col("supplier_name").isNotNull()).select(F.col("name").alias("against"))
    return (v.gl_entry.where(F.col("credit") > 0).join(named, "against", "left_anti")
            .select("name", "against", "credit"))


_DAILY = f"""daily AS (SELECT posting_date, {msum('base_grand_total')} AS amt FROM "tabSales Invoice" WHERE docstatus = 1 GROUP BY posting_date)"""


def _daily(v) -> DataFrame:
    return S.submitted(v.sales_invoice).groupBy("posting_date").agg(fn.money_sum("base_grand_total").alias("amt"))


@q("j_cross_scalar", f"""WITH {_DAILY}
SELECT d.posting_date, CAST(d.amt AS DOUBLE) AS sales, CAST(t.total AS DOUBLE) AS all_sales
FROM daily d CROSS JOIN (SELECT SUM(amt) AS total FROM daily) t""")
def j_cross_scalar(v):
    d = _daily(v)
    return attach_scalar(d, d.agg(F.sum("amt").alias("total"))).select(
        "posting_date", _d("amt").alias("sales"), _d("total").alias("all_sales"))


_MONTHS = """months AS (SELECT DISTINCT CAST(date_trunc('month', posting_date) AS DATE) AS m FROM "tabSales Invoice" WHERE docstatus = 1),
all_days AS (SELECT CAST(unnest(generate_series(CAST(m AS TIMESTAMP), CAST(last_day(m) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS posting_date FROM months)"""


def _sales_calendar(v) -> DataFrame:
    """Every day of every month that has a submitted invoice (derived from
    the data, so it grows with the ledger's time span)."""
    m = S.submitted(v.sales_invoice).select(F.trunc("posting_date", "MM").alias("m")).distinct()
    return m.select(F.explode(F.sequence("m", F.last_day("m"))).alias("posting_date"))


@q("j_calendar", f"""WITH {_DAILY}, {_MONTHS}
SELECT a.posting_date, CAST(d.amt AS DOUBLE) AS sales FROM all_days a LEFT JOIN daily d ON a.posting_date = d.posting_date""")
def j_calendar(v):
    return _sales_calendar(v).join(_daily(v), "posting_date", "left").select("posting_date", _d("amt").alias("sales"))


_INV_OUT = f"""inv_out AS (SELECT supplier AS supplier_id, MIN(supplier_name) AS supplier_name, {msum('outstanding_amount')} AS total_outstanding
  FROM "tabPurchase Invoice" WHERE docstatus = 1 GROUP BY supplier)"""
_UNALLOC = f"""unalloc AS (SELECT party AS supplier_id, {msum('base_paid_amount - base_total_allocated_amount')} AS total_debits
  FROM "tabPayment Entry" WHERE docstatus = 1 AND payment_type = 'Pay' AND party_type = 'Supplier'
    AND base_paid_amount - base_total_allocated_amount > 0 GROUP BY party)"""


def _inv_out(v):
    return (L.submitted(v.purchase_invoice).groupBy(F.col("supplier").alias("supplier_id"))
            .agg(F.min("supplier_name").alias("supplier_name"), _d(fn.money_sum("outstanding_amount")).alias("Total_Outstanding")))


def _unalloc(v):
    return L.unallocated_payments(v.payment_entry).select("supplier_id", F.col("total_unallocated_amount").alias("total_debits"))


@q("j_aggregates", f"""WITH {_INV_OUT}, {_UNALLOC}
SELECT i.supplier_id, CAST(i.total_outstanding AS DOUBLE) AS Total_Outstanding, CAST(u.total_debits AS DOUBLE) AS total_debits
FROM inv_out i LEFT JOIN unalloc u ON i.supplier_id = u.supplier_id""")
def j_aggregates(v):
    return _inv_out(v).join(_unalloc(v), "supplier_id", "left").select("supplier_id", "Total_Outstanding", "total_debits")


# ---------------------------------------------------------------- 2.4 A1-A17

@q("a_sum_by_key", f"""SELECT party, {dsum('credit')} AS total_credit FROM "tabGL Entry" GROUP BY party""")
def a_sum_by_key(v):
    return v.gl_entry.groupBy("party").agg(_d(fn.money_sum("credit")).alias("total_credit"))


@q("a_sum_by_keys", f"""SELECT customer, customer_name, {dsum('base_grand_total')} AS total_sales FROM "tabSales Invoice" GROUP BY customer, customer_name""")
def a_sum_by_keys(v):
    return v.sales_invoice.groupBy("customer", "customer_name").agg(_d(fn.money_sum("base_grand_total")).alias("total_sales"))


@q("a_global_sum", f"""SELECT {dsum('base_grand_total')} AS total_sales FROM "tabSales Invoice" WHERE docstatus = 1""")
def a_global_sum(v):
    return S.submitted(v.sales_invoice).agg(_d(fn.money_sum("base_grand_total")).alias("total_sales"))


@q("a_debit_credit", f"""SELECT account, {dsum('debit')} AS total_debit, {dsum('credit')} AS total_credit FROM "tabGL Entry" GROUP BY account""")
def a_debit_credit(v):
    return v.gl_entry.groupBy("account").agg(_d(fn.money_sum("debit")).alias("total_debit"),
                                             _d(fn.money_sum("credit")).alias("total_credit"))


@q("a_net_balance", f"""SELECT party, CAST({msum('credit')} - {msum('debit')} AS DOUBLE) AS balance FROM "tabGL Entry" GROUP BY party""")
def a_net_balance(v):
    return v.gl_entry.groupBy("party").agg(_d(fn.money_sum("credit") - fn.money_sum("debit")).alias("balance"))


_OPEN_INV = f"""open_inv AS (
  SELECT supplier AS supplier_id,
         CASE WHEN party_account_currency = 'USD' THEN outstanding_amount * conversion_rate ELSE outstanding_amount END AS amt,
         date_diff('day', due_date, {sql_date(AS_OF)}) AS age
  FROM "tabPurchase Invoice" WHERE docstatus = 1 AND status NOT IN ('Paid', 'Return')
    AND date_diff('day', due_date, {sql_date(AS_OF)}) >= 0)"""
_BUCKET_COND = ["age BETWEEN 0 AND 30", "age BETWEEN 31 AND 60", "age BETWEEN 61 AND 90", "age BETWEEN 91 AND 120", "age >= 121"]
_AGEING_SQL = f"""WITH {_OPEN_INV}
SELECT supplier_id,
  {", ".join(f'CAST(COALESCE(SUM(CASE WHEN {c} THEN CAST(amt AS DECIMAL(18,4)) ELSE 0 END), 0) AS DOUBLE) AS "{b}"' for b, c in zip(_BUCKETS, _BUCKET_COND))},
  {dsum('amt')} AS Outstanding_From_Invoices
FROM open_inv GROUP BY supplier_id"""


@q("a_conditional_sum", _AGEING_SQL)
def a_conditional_sum(v):
    return L.ageing_buckets(L.open_invoices(v.purchase_invoice, AS_OF), "supplier_id", "age_days", "amount")


@q("a_conditional_sum_null", """SELECT gl.account,
  CAST(SUM(CASE WHEN acc.root_type = 'Expense' THEN CAST(gl.debit AS DECIMAL(18,4)) - CAST(gl.credit AS DECIMAL(18,4)) END) AS DOUBLE) AS total_expenses,
  CAST(SUM(CASE WHEN acc.root_type = 'Income' THEN CAST(gl.credit AS DECIMAL(18,4)) - CAST(gl.debit AS DECIMAL(18,4)) END) AS DOUBLE) AS total_income
FROM "tabGL Entry" gl JOIN "tabAccount" acc ON gl.account = acc.name GROUP BY gl.account""")
def a_conditional_sum_null(v):
    acc = v.account.select(F.col("name").alias("account"), "root_type")
    rows = v.gl_entry.join(acc, "account", "inner")
    exp = F.when(F.col("root_type") == "Expense", fn.money("debit") - fn.money("credit"))
    inc = F.when(F.col("root_type") == "Income", fn.money("credit") - fn.money("debit"))
    return rows.groupBy("account").agg(_d(F.sum(exp)).alias("total_expenses"), _d(F.sum(inc)).alias("total_income"))


@q("a_negated_sum", f"""SELECT pe.party AS supplier_id, CAST(-{msum('per.allocated_amount')} AS DOUBLE) AS sum_already_allocated
FROM "tabPayment Entry Reference" per JOIN "tabPayment Entry" pe ON per.parent = pe.name
WHERE per.reference_doctype = 'Journal Entry' AND pe.payment_type = 'Pay' AND pe.docstatus = 1 GROUP BY pe.party""")
def a_negated_sum(v):
    rows = L.allocated_payment_rows(v.payment_entry_reference, v.payment_entry, party_type=None)
    return rows.groupBy(F.col("party").alias("supplier_id")).agg(_d(-fn.money_sum("allocated_amount")).alias("sum_already_allocated"))


@q("a_round_sum", f"""SELECT item_code, CAST(ROUND({msum('tonnes_input')}, 2) AS DOUBLE) AS total_tonnes FROM "tabSales Invoice Item" GROUP BY item_code""")
def a_round_sum(v):
    return v.sales_invoice_item.groupBy("item_code").agg(_d(F.round(fn.money_sum("tonnes_input"), 2)).alias("total_tonnes"))


@q("a_sum_default", f"""WITH per AS (SELECT customer, {msum('base_grand_total')} AS amt FROM "tabSales Invoice" WHERE docstatus = 1 GROUP BY customer)
SELECT cu.name AS customer, CAST(IFNULL(per.amt, 0) AS DOUBLE) AS total_sales FROM "tabCustomer" cu LEFT JOIN per ON cu.name = per.customer""")
def a_sum_default(v):
    per = S.submitted(v.sales_invoice).groupBy("customer").agg(fn.money_sum("base_grand_total").alias("amt"))
    cu = v.customer.select(F.col("name").alias("customer"))
    return cu.join(per, "customer", "left").select("customer", _d(F.coalesce(F.col("amt"), F.lit(0))).alias("total_sales"))


_JOURNAL_LINES = """journal_lines AS (
  SELECT jea.party, jea.debit, jea.credit, jea.reference_type, jea.reference_name
  FROM "tabJournal Entry Account" jea JOIN "tabJournal Entry" je ON jea.parent = je.name
  JOIN "tabAccount" acc ON jea.account = acc.name
  WHERE jea.docstatus = 1 AND je.docstatus = 1 AND jea.party_type = 'Supplier' AND je.is_system_generated = 0
    AND acc.account_type = 'Payable')"""


@q("a_union_reagg", f"""WITH {_JOURNAL_LINES},
parts AS (
  SELECT supplier AS supplier_id, {msum('outstanding_amount')} AS amt FROM "tabPurchase Invoice" WHERE docstatus = 1 GROUP BY supplier
  UNION ALL SELECT party, {msum('credit')} FROM journal_lines WHERE credit > 0 AND reference_type IS NULL AND reference_name IS NULL GROUP BY party)
SELECT supplier_id, CAST(SUM(amt) AS DOUBLE) AS Total_Outstanding FROM parts GROUP BY supplier_id""")
def a_union_reagg(v):
    inv = (L.submitted(v.purchase_invoice).groupBy(F.col("supplier").alias("supplier_id"))
           .agg(fn.money_sum("outstanding_amount").alias("amt")))
    jl = L.journal_payable_lines(v.journal_entry_account, v.journal_entry, v.account).where(F.col("is_credit"))
    jc = jl.groupBy(F.col("party").alias("supplier_id")).agg(fn.money_sum("credit").alias("amt"))
    return union_positional(inv, jc).groupBy("supplier_id").agg(_d(F.sum("amt")).alias("Total_Outstanding"))


@q("a_two_level", f"""WITH per AS (SELECT customer, {msum('base_grand_total')} AS amt FROM "tabSales Invoice" WHERE docstatus = 1 GROUP BY customer)
SELECT CAST(SUM(amt) AS DOUBLE) AS total_sales FROM per""")
def a_two_level(v):
    per = S.submitted(v.sales_invoice).groupBy("customer").agg(fn.money_sum("base_grand_total").alias("amt"))
    return per.agg(_d(F.sum("amt")).alias("total_sales"))


_PER_CUST = f"""per AS (SELECT customer, ROUND({msum('base_grand_total')}, 2) AS amt FROM "tabSales Invoice"
  WHERE docstatus = 1 GROUP BY customer)"""


def _per_customer(v):
    return (S.submitted(v.sales_invoice).groupBy("customer").agg(F.round(fn.money_sum("base_grand_total"), 2).alias("amt")))


@q("a_total_row", f"""WITH {_PER_CUST}
SELECT customer, CAST(amt AS DOUBLE) AS total FROM per
UNION ALL SELECT 'TOTAL', CAST(ROUND(SUM(amt), 2) AS DOUBLE) FROM per""")
def a_total_row(v):
    both = detail_and_total(_per_customer(v), ["customer"], [F.round(F.sum("amt"), 2).alias("amt")])
    return both.select(F.when(F.col("__total"), F.lit("TOTAL")).otherwise(F.col("customer")).alias("customer"),
                       _d("amt").alias("total"))


@q("a_group_constant", """SELECT 'Totals' AS label,
  CAST(SUM(CASE WHEN status = 'Paid' THEN CAST(base_grand_total AS DECIMAL(18,4)) ELSE 0 END) AS DOUBLE) AS paid,
  CAST(SUM(CASE WHEN status = 'Unpaid' THEN CAST(base_grand_total AS DECIMAL(18,4)) ELSE 0 END) AS DOUBLE) AS unpaid
FROM "tabSales Invoice" WHERE docstatus = 1 GROUP BY label""")
def a_group_constant(v):
    rows = S.submitted(v.sales_invoice)
    amt = fn.money("base_grand_total")
    zero = F.lit(0).cast(fn.MONEY)
    return group_by_constant(rows, "label", "Totals",
                             _d(F.sum(F.when(F.col("status") == "Paid", amt).otherwise(zero))).alias("paid"),
                             _d(F.sum(F.when(F.col("status") == "Unpaid", amt).otherwise(zero))).alias("unpaid"))


@q("a_representative", f"""SELECT party, MIN(party_name) AS party_name, {dsum('base_paid_amount')} AS paid
FROM "tabPayment Entry" WHERE docstatus = 1 GROUP BY party""")
def a_representative(v):
    out = sums_with_min_text(L.submitted(v.payment_entry), ["party"], {"paid": fn.money_sum("base_paid_amount")},
                             "party_name")
    return out.select("party", "party_name", _d("paid").alias("paid"))


# Amounts of nine decimals, as the source database stores them: two from the price, nine from the part.
_NINE = "CAST(CAST(l_partkey * 7919 + l_linenumber AS DECIMAL(9,0)) * CAST(0.000000001 AS DECIMAL(9,9)) AS DECIMAL(18,9))"
_PRICE = "CAST(l_extendedprice AS DECIMAL(18,2))"


def _nine():
    """``_NINE`` for every part key: the statement's DECIMAL(9,0) ends at part 126,278; these types hold any BIGINT."""
    units = F.col("l_partkey").cast("decimal(19,0)") * F.lit(Decimal(7919)) + F.col("l_linenumber")
    return (units * F.lit(Decimal("0.000000001"))).cast("decimal(25,9)")


@q("a_sum_exact", f"""SELECT l_suppkey, CAST(SUM(CAST({_PRICE} + {_NINE} AS DECIMAL(28,9))) AS VARCHAR) AS total,
  CAST(ROUND(SUM(CAST({_PRICE} + {_NINE} AS DECIMAL(28,9))), 2) AS DOUBLE) AS rounded_total
FROM lineitem GROUP BY l_suppkey""")
def a_sum_exact(v):
    amount = F.col("l_extendedprice").cast("decimal(18,2)") + _nine()
    return v.raw("lineitem").groupBy("l_suppkey").agg(fn.exact_sum(amount).alias("t")).select(
        "l_suppkey", F.col("t").cast("string").alias("total"), _d(fn.money_round("t")).alias("rounded_total"))


# The outstanding invoices in base currency, at a rate of nine decimals.
_RATE = "CASE WHEN party_account_currency = 'USD' THEN CAST(conversion_rate AS DECIMAL(13,4)) + 0.123456789 ELSE 1 END"


@q("outstanding_base_exact", f"""WITH x AS (SELECT supplier, SUM(CAST(outstanding_amount AS DECIMAL(20,2)) * CAST({_RATE} AS DECIMAL(18,9))) AS t
  FROM "tabPurchase Invoice" WHERE docstatus = 1 GROUP BY supplier)
SELECT supplier AS supplier_id, CAST(CAST(ROUND(t, 9) AS DECIMAL(38,9)) AS VARCHAR) AS outstanding,
  CAST(ROUND(t, 2) AS DOUBLE) AS rounded_outstanding FROM x""")
def outstanding_base_exact(v):
    rate = F.col("conversion_rate").cast("decimal(13,4)") + F.lit(Decimal("0.123456789"))
    out = L.outstanding_in_base(v.purchase_invoice.withColumn("conversion_rate", rate.cast("decimal(18,9)")))
    return out.select("supplier_id", F.col("outstanding").cast("string").alias("outstanding"),
                      _d(fn.money_round("outstanding")).alias("rounded_outstanding"))


# ---------------------------------------------------------------- 2.5 W1-W4

@q("w_total", f"""WITH per AS (SELECT customer, {msum('base_grand_total')} AS amt FROM "tabSales Invoice" WHERE docstatus = 1 GROUP BY customer)
SELECT customer, CAST(amt AS DOUBLE) AS total_sales_per, CAST(SUM(amt) OVER () AS DOUBLE) AS total_sales_revenue FROM per""")
def w_total(v):
    per = S.submitted(v.sales_invoice).groupBy("customer").agg(fn.money_sum("base_grand_total").alias("amt"))
    out = attach_scalar(per, per.agg(F.sum("amt").alias("tot")))
    return out.select("customer", _d("amt").alias("total_sales_per"), _d("tot").alias("total_sales_revenue"))


@q("w_share_pct", f"""WITH per AS (SELECT item_code, {msum('base_amount')} AS amt FROM "tabSales Invoice Item" GROUP BY item_code)
SELECT item_code, CAST(amt AS DOUBLE) AS total_sales_per, CAST(SUM(amt) OVER () AS DOUBLE) AS total_sales_revenue,
  CAST(amt AS DOUBLE) / NULLIF(CAST(SUM(amt) OVER () AS DOUBLE), 0) * 100 AS percentage FROM per""")
def w_share_pct(v):
    return S.contribution(v.sales_invoice_item, ["item_code"], "base_amount")


_MONTH_DENSE = f"""md AS (SELECT posting_date, {msum('base_grand_total')} AS amt FROM "tabSales Invoice"
    WHERE docstatus = 1 AND posting_date BETWEEN {sql_date(_MS)} AND {sql_date(_ME)} GROUP BY posting_date),
  cal AS (SELECT CAST(d AS DATE) AS posting_date FROM generate_series(CAST({sql_date(_MS)} AS TIMESTAMP), CAST({sql_date(_ME)} AS TIMESTAMP), INTERVAL 1 DAY) g(d)),
  dense AS (SELECT cal.posting_date, COALESCE(md.amt, 0) AS amt FROM cal LEFT JOIN md ON cal.posting_date = md.posting_date)"""


@q("w_running_sum", f"""WITH {_MONTH_DENSE}
SELECT posting_date, CAST(amt AS DOUBLE) AS sales_today, CAST(SUM(amt) OVER (ORDER BY posting_date) AS DOUBLE) AS cumulative_sales FROM dense""")
def w_running_sum(v):
    d = S.densify_daily(S.calendar(v.spark, AS_OF), S.month_sales_by_day(v.sales_invoice, AS_OF))
    return running_total(d, "sales_dec", "posting_date", "cum").select(
        "posting_date", _d("sales_dec").alias("sales_today"), _d("cum").alias("cumulative_sales"))


@q("w_running_sum_of_sum", """SELECT posting_date, CAST(SUM(SUM(CAST(base_grand_total AS DECIMAL(18,4)))) OVER (ORDER BY posting_date) AS DOUBLE) AS cumulative_sales
FROM "tabSales Invoice" WHERE docstatus = 1 GROUP BY posting_date""")
def w_running_sum_of_sum(v):
    return running_sums(_daily(v), "amt", "posting_date", "cum").select("posting_date", _d("cum").alias("cumulative_sales"))


@q("w_running_balance", f"""SELECT name, account, posting_date,
  CAST(SUM(CAST(debit AS DECIMAL(18,4)) - CAST(credit AS DECIMAL(18,4))) OVER (PARTITION BY account ORDER BY posting_date) AS DOUBLE) AS balance
FROM "tabGL Entry" WHERE is_cancelled = 0""")
def w_running_balance(v):
    """Every ledger line with its account's balance at the end of its day."""
    lines = v.gl_entry.where(F.col("is_cancelled") == 0).select(
        "name", "account", "posting_date", (fn.money("debit") - fn.money("credit")).alias("net"))
    return running_total(lines, "net", "posting_date", "cum", by=["account"]).select(
        "name", "account", "posting_date", _d("cum").alias("balance"))


# ---------------------------------------------------------------- 2.6 O1-O3

@q("o_sort_asc", """SELECT name, posting_date, base_grand_total FROM "tabSales Invoice" ORDER BY posting_date ASC NULLS FIRST""")
def o_sort_asc(v):
    # tie-breaker: a day holding a third of all invoices still splits across tasks
    return v.sales_invoice.select("name", "posting_date", "base_grand_total").orderBy(
        *S.detail_order("posting_date", "name"))


@q("o_sort_desc", f"""SELECT customer, {dsum('base_grand_total')} AS total_sales FROM "tabSales Invoice" WHERE docstatus = 1
GROUP BY customer ORDER BY total_sales DESC NULLS LAST""")
def o_sort_desc(v):
    return (S.submitted(v.sales_invoice).groupBy("customer").agg(_d(fn.money_sum("base_grand_total")).alias("total_sales"))
            .orderBy(F.desc_nulls_last("total_sales")))


@q("o_sort_multi", """SELECT name, posting_date, customer FROM "tabSales Invoice" ORDER BY name, posting_date""")
def o_sort_multi(v):
    return v.sales_invoice.select("name", "posting_date", "customer").orderBy(F.asc_nulls_first("name"),
                                                                              F.asc_nulls_first("posting_date"))


# ---------------------------------------------------------------- 2.7 U1-U4

_DEBIT_PARTS = f"""{_JOURNAL_LINES},
pay_open AS (SELECT party AS supplier_id, {msum('base_paid_amount - base_total_allocated_amount')} AS amt FROM "tabPayment Entry"
  WHERE docstatus = 1 AND payment_type = 'Pay' AND party_type = 'Supplier' AND base_paid_amount - base_total_allocated_amount > 0 GROUP BY party),
jd_open AS (SELECT party AS supplier_id, {msum('debit')} AS amt FROM journal_lines WHERE debit > 0 AND reference_type IS NULL GROUP BY party),
jd_alloc AS (SELECT party AS supplier_id, {msum('debit')} AS amt FROM journal_lines
  WHERE debit > 0 AND reference_type IS NOT NULL AND reference_type <> 'Purchase Invoice' GROUP BY party),
pay_alloc AS (SELECT pe.party AS supplier_id, {msum('per.allocated_amount')} AS amt
  FROM "tabPayment Entry Reference" per JOIN "tabPayment Entry" pe ON per.parent = pe.name
  WHERE per.reference_doctype = 'Journal Entry' AND pe.payment_type = 'Pay' AND pe.docstatus = 1 AND pe.party_type = 'Supplier' GROUP BY pe.party)"""


def _debit_parts(v):
    jl = L.journal_payable_lines(v.journal_entry_account, v.journal_entry, v.account)
    rest = F.col("base_paid_amount") - F.col("base_total_allocated_amount")
    pay_open = (L.supplier_payments(v.payment_entry).where(rest > 0).groupBy(F.col("party").alias("supplier_id"))
                .agg(fn.money_sum(rest).alias("amt")))
    jd_open = jl.where(F.col("is_debit_open")).groupBy(F.col("party").alias("supplier_id")).agg(fn.money_sum("debit").alias("amt"))
    jd_alloc = jl.where(F.col("is_debit_alloc")).groupBy(F.col("party").alias("supplier_id")).agg(fn.money_sum("debit").alias("amt"))
    pay_alloc = (L.allocated_payment_rows(v.payment_entry_reference, v.payment_entry)
                 .groupBy(F.col("party").alias("supplier_id")).agg(fn.money_sum("allocated_amount").alias("amt")))
    return pay_open, jd_open, jd_alloc, pay_alloc


@q("u_union_all", f"""WITH {_DEBIT_PARTS}
SELECT supplier_id, CAST(amt AS DOUBLE) AS amount FROM pay_open UNION ALL SELECT supplier_id, CAST(amt AS DOUBLE) FROM jd_open""")
def u_union_all(v):
    pay_open, jd_open, _, _ = _debit_parts(v)
    return union_positional(pay_open, jd_open).select("supplier_id", _d("amt").alias("amount"))


@q("u_union_many", f"""WITH {_DEBIT_PARTS}
SELECT supplier_id, CAST(SUM(amt) AS DOUBLE) AS total_debits FROM (
  SELECT * FROM pay_open UNION ALL SELECT * FROM jd_open UNION ALL SELECT * FROM jd_alloc UNION ALL SELECT * FROM pay_alloc) u
GROUP BY supplier_id""")
def u_union_many(v):
    return union_positional(*_debit_parts(v)).groupBy("supplier_id").agg(_d(F.sum("amt")).alias("total_debits"))


@q("u_union_filler", f"""WITH {_PER_CUST}
SELECT customer, CAST(NULL AS DATE) AS posting_date, CAST(amt AS DOUBLE) AS total FROM per
UNION ALL SELECT 'Sales Target', NULL, {MONTHLY_TARGET} / 31 FROM (SELECT COUNT(*) FROM per) t
UNION ALL SELECT '', {sql_date(AS_OF)}, CAST(SUM(amt) AS DOUBLE) FROM per""")
def u_union_filler(v):
    schema = StructType([StructField("customer", StringType()), StructField("posting_date", DateType()),
                         StructField("total", DoubleType())])
    per = _per_customer(v)
    detail = per.select(*labelled_row(schema, {"customer": F.col("customer"), "total": F.col("amt")}))
    target = per.agg(F.count(F.lit(1))).select(*labelled_row(schema, {
        "customer": F.lit("Sales Target"), "total": F.lit(MONTHLY_TARGET) / F.lit(31)}))
    today = per.agg(F.sum("amt").alias("amt")).select(*labelled_row(schema, {
        "posting_date": as_date(AS_OF), "total": F.col("amt")}))
    return union_positional(detail, target, today)


@q("u_calendar", f"""WITH {_MONTHS} SELECT posting_date FROM all_days""")
def u_calendar(v):
    return _sales_calendar(v)


# ---------------------------------------------------------------- 2.8 F1-F16

@q("f_week_sunday", """SELECT name, posting_date, CAST(strftime(posting_date, '%U') AS INTEGER) AS week_no FROM "tabSales Invoice" """)
def f_week_sunday(v):
    return v.sales_invoice.select("name", "posting_date", fn.week_sunday("posting_date").alias("week_no"))


@q("f_to_date", """SELECT name, CAST(creation AS DATE) AS order_date FROM "tabSales Order" """)
def f_to_date(v):
    return v.sales_order.select("name", F.to_date("creation").alias("order_date"))


@q("f_date_sub", """SELECT name, transaction_date - 7 AS week_before FROM "tabSales Order" """)
def f_date_sub(v):
    return v.sales_order.select("name", F.date_sub("transaction_date", 7).alias("week_before"))


@q("f_date_add", """SELECT name, posting_date + 1 AS next_day FROM "tabSales Invoice" """)
def f_date_add(v):
    return v.sales_invoice.select("name", F.date_add("posting_date", 1).alias("next_day"))


@q("f_month_start", """SELECT name, CAST(date_trunc('month', posting_date) AS DATE) AS month_start FROM "tabSales Invoice" """)
def f_month_start(v):
    return v.sales_invoice.select("name", fn.month_start(F.col("posting_date")).alias("month_start"))


@q("f_last_day", """SELECT name, last_day(posting_date) AS month_end FROM "tabSales Invoice" """)
def f_last_day(v):
    return v.sales_invoice.select("name", fn.month_end(F.col("posting_date")).alias("month_end"))


@q("f_days_in_month", """SELECT name, CAST(day(last_day(posting_date)) AS INTEGER) AS days_in_month FROM "tabSales Invoice" """)
def f_days_in_month(v):
    return v.sales_invoice.select("name", fn.days_in_month(F.col("posting_date")).alias("days_in_month"))


@q("f_month_year", """SELECT name, CAST(month(posting_date) AS INTEGER) AS month_no, CAST(year(posting_date) AS INTEGER) AS year_no FROM "tabSales Invoice" """)
def f_month_year(v):
    return v.sales_invoice.select("name", F.month("posting_date").alias("month_no"), F.year("posting_date").alias("year_no"))


@q("f_datediff", f"""SELECT name, CAST(date_diff('day', due_date, {sql_date(AS_OF)}) AS INTEGER) AS days_after_due_date FROM "tabPurchase Invoice" """)
def f_datediff(v):
    return v.purchase_invoice.select("name", F.datediff(as_date(AS_OF), F.col("due_date")).alias("days_after_due_date"))


@q("f_round", """SELECT parent, item_code, ROUND(rate * 1.16, 2) AS gross_rate FROM "tabSales Order Item" """)
def f_round(v):
    return v.sales_order_item.select("parent", "item_code", F.round(F.col("rate") * F.lit(1.16), 2).alias("gross_rate"))


@q("f_greatest", """SELECT name, CAST(GREATEST(date_diff('day', posting_date, last_day(posting_date)), 1) AS INTEGER) AS days_left FROM "tabSales Invoice" """)
def f_greatest(v):
    return v.sales_invoice.select("name", F.greatest(F.datediff(F.last_day("posting_date"), F.col("posting_date")),
                                                     F.lit(1)).alias("days_left"))


@q("f_ifnull", """SELECT name, IFNULL(reference_type, 'None') AS reference_type FROM "tabJournal Entry Account" """)
def f_ifnull(v):
    return v.journal_entry_account.select("name", F.ifnull(F.col("reference_type"), F.lit("None")).alias("reference_type"))


@q("f_coalesce", """SELECT name, COALESCE(company_vehicle, customer_provided_vehicle, transporter_vehicle_number) AS any_vehicle FROM "tabDelivery Note" """)
def f_coalesce(v):
    return v.delivery_note.select("name", F.coalesce("company_vehicle", "customer_provided_vehicle",
                                                     "transporter_vehicle_number").alias("any_vehicle"))


@q("f_case", """SELECT name, CASE WHEN status IN ('Closed', 'Completed') THEN 'done' WHEN status = 'On Hold' THEN 'held'
  WHEN status IS NULL THEN NULL ELSE 'open' END AS state FROM "tabSales Order" """)
def f_case(v):
    s = F.col("status")
    return v.sales_order.select("name", F.when(s.isin("Closed", "Completed"), "done").when(s == "On Hold", "held")
                                .when(s.isNull(), F.lit(None)).otherwise("open").alias("state"))


@q("f_safe_divide", """SELECT name, base_total_taxes_and_charges / NULLIF(total_qty, 0) AS tax_per_unit FROM "tabSales Invoice" """)
def f_safe_divide(v):
    return v.sales_invoice.select("name", fn.safe_divide("base_total_taxes_and_charges", "total_qty").alias("tax_per_unit"))


# ---------------------------------------------------------------- 2.11 D1-D24

@q("to_base_currency", """SELECT name, CASE WHEN party_account_currency = 'USD' THEN outstanding_amount * conversion_rate ELSE outstanding_amount END AS outstanding_base
FROM "tabPurchase Invoice" """)
def to_base_currency(v):
    return v.purchase_invoice.select("name", fn.to_base_currency("outstanding_amount", "party_account_currency",
                                                                 "conversion_rate").alias("outstanding_base"))


@q("first_non_blank", """SELECT name, CASE WHEN company_vehicle <> '' THEN company_vehicle WHEN customer_provided_vehicle <> '' THEN customer_provided_vehicle
  WHEN transporter_vehicle_number <> '' THEN transporter_vehicle_number END AS vehicle_number FROM "tabDelivery Note" """)
def first_non_blank(v):
    return v.delivery_note.select("name", fn.first_non_blank("company_vehicle", "customer_provided_vehicle",
                                                             "transporter_vehicle_number").alias("vehicle_number"))


_TAXQ = "CASE WHEN si.base_total_taxes_and_charges <> 0 THEN si.base_total_taxes_and_charges / NULLIF(si.total_qty, 0) ELSE 0 END"


@q("tax_per_unit", f"""SELECT sii.parent, sii.item_code, {_TAXQ} AS tax_per_item, sii.base_rate + {_TAXQ} AS rate_after_tax,
  (sii.base_rate + {_TAXQ}) * sii.qty AS amount_after_tax
FROM "tabSales Invoice Item" sii JOIN "tabSales Invoice" si ON sii.parent = si.name""")
def tax_per_unit(v):
    si = v.sales_invoice.select(F.col("name").alias("parent"),
                                fn.tax_per_unit("base_total_taxes_and_charges", "total_qty").alias("tax_per_item"))
    j = v.sales_invoice_item.join(si, "parent", "inner")
    after = F.col("base_rate") + F.col("tax_per_item")
    return j.select("parent", "item_code", "tax_per_item", after.alias("rate_after_tax"),
                    (after * F.col("qty")).alias("amount_after_tax"))


@q("add_item_tax", """SELECT parent, item_code, CASE WHEN item_tax_template = 'Kenya Tax - NML' THEN ROUND(rate * 1.16, 2) ELSE rate END AS rate
FROM "tabSales Order Item" """)
def add_item_tax(v):
    return v.sales_order_item.select("parent", "item_code", fn.add_item_tax("rate", "item_tax_template").alias("rate"))


_SO_LINES = """lines AS (SELECT soi.parent, soi.item_code, soi.weight_per_unit, soi.qty - soi.delivered_qty AS remaining, so.currency,
    soi.rate, so.conversion_rate
  FROM "tabSales Order Item" soi JOIN "tabSales Order" so ON soi.parent = so.name)"""
_CAP = """CASE WHEN remaining >= 680 AND weight_per_unit = 0.025 AND currency IN ('KES', 'USD') THEN 680
  WHEN remaining = 480 AND weight_per_unit = 0.025 THEN 480 WHEN remaining >= 340 AND currency = 'KES' THEN 340
  WHEN remaining >= 560 AND currency = 'USD' THEN 560 ELSE remaining END"""


def _so_lines(v):
    so = v.sales_order.select(F.col("name").alias("parent"), "currency", "conversion_rate")
    return v.sales_order_item.join(so, "parent", "inner").select(
        "parent", "item_code", "weight_per_unit", (F.col("qty") - F.col("delivered_qty")).alias("remaining"),
        "currency", "rate", "conversion_rate")


@q("cap_to_truckload", f"""WITH {_SO_LINES} SELECT parent, item_code, remaining, {_CAP} AS bags_to_deliver FROM lines""")
def cap_to_truckload(v):
    return _so_lines(v).select("parent", "item_code", "remaining",
                               fn.cap_to_truckload("remaining", "weight_per_unit", "currency").alias("bags_to_deliver"))


@q("line_tonnes_value", f"""WITH {_SO_LINES}
SELECT parent, item_code, weight_per_unit * ({_CAP}) AS quantity_in_tonnes,
  ({_CAP}) * CASE WHEN currency = 'USD' THEN rate * conversion_rate ELSE rate END AS product_amount FROM lines""")
def line_tonnes_value(v):
    bags = fn.cap_to_truckload("remaining", "weight_per_unit", "currency")
    rate = fn.to_base_currency("rate", "currency", "conversion_rate")
    return _so_lines(v).select("parent", "item_code", line_tonnes("weight_per_unit", bags).alias("quantity_in_tonnes"),
                               line_value(bags, rate).alias("product_amount"))


_OPEN_ORDER_LINES = f"""SELECT so.customer_name, so.name AS sales_order_id, CAST(so.creation AS DATE) AS order_date, so.delivery_date, st.sales_person,
  soi.item_code, soi.item_name,
  soi.weight_per_unit * (CASE WHEN r >= 680 AND soi.weight_per_unit = 0.025 AND so.currency IN ('KES', 'USD') THEN 680
    WHEN r = 480 AND soi.weight_per_unit = 0.025 THEN 480 WHEN r >= 340 AND so.currency = 'KES' THEN 340
    WHEN r >= 560 AND so.currency = 'USD' THEN 560 ELSE r END) AS quantity_in_tonnes,
  (CASE WHEN r >= 680 AND soi.weight_per_unit = 0.025 AND so.currency IN ('KES', 'USD') THEN 680
    WHEN r = 480 AND soi.weight_per_unit = 0.025 THEN 480 WHEN r >= 340 AND so.currency = 'KES' THEN 340
    WHEN r >= 560 AND so.currency = 'USD' THEN 560 ELSE r END)
  * (CASE WHEN so.currency = 'USD' THEN gross * so.conversion_rate ELSE gross END) AS product_amount
FROM "tabSales Order" so
JOIN (SELECT *, qty - delivered_qty AS r,
        CASE WHEN item_tax_template = 'Kenya Tax - NML' THEN ROUND(rate * 1.16, 2) ELSE rate END AS gross
      FROM "tabSales Order Item") soi ON soi.parent = so.name
LEFT JOIN "tabSales Team" st ON st.parent = so.name
WHERE so.docstatus = 1 AND so.per_delivered <= 60 AND so.transaction_date >= {sql_date(AS_OF)} - 14
  AND so.status NOT IN ('Closed', 'Completed', 'On Hold') AND soi.item_code <> 'SRV-001' AND soi.r > 0"""


@q("open_order_lines", _OPEN_ORDER_LINES)
def open_order_lines(v):
    return S.open_order_lines(v.sales_order, v.sales_order_item, v.sales_team, AS_OF, 14)


@q("ageing_buckets", _AGEING_SQL)
def ageing_buckets(v):
    return L.ageing_buckets(L.open_invoices(v.purchase_invoice, AS_OF), "supplier_id", "age_days", "amount")


@q("unallocated_payments", f"""SELECT party AS supplier_id, MIN(party_name) AS supplier_name,
  {dsum('base_paid_amount - base_total_allocated_amount')} AS total_unallocated_amount
FROM "tabPayment Entry" WHERE docstatus = 1 AND payment_type = 'Pay' AND party_type = 'Supplier'
  AND base_paid_amount - base_total_allocated_amount > 0 GROUP BY party""")
def unallocated_payments(v):
    return L.unallocated_payments(v.payment_entry)


@q("allocated_payments", f"""SELECT pe.party AS supplier_id, MIN(pe.party_name) AS supplier_name, {dsum('per.allocated_amount')} AS debits_allocated
FROM "tabPayment Entry Reference" per JOIN "tabPayment Entry" pe ON per.parent = pe.name
WHERE per.reference_doctype = 'Journal Entry' AND pe.payment_type = 'Pay' AND pe.docstatus = 1 AND pe.party_type = 'Supplier'
GROUP BY pe.party""")
def allocated_payments(v):
    return L.allocated_payments(v.payment_entry_reference, v.payment_entry)


def _journal_sql(cond: str, amount: str, out: str) -> str:
    return f"""WITH {_JOURNAL_LINES}
SELECT jl.party AS supplier_id, sp.supplier_name, {dsum('jl.' + amount)} AS {out}
FROM journal_lines jl LEFT JOIN "tabSupplier" sp ON jl.party = sp.name WHERE {cond} GROUP BY jl.party, sp.supplier_name"""


def _journal(v, flag, amount, out):
    jl = L.journal_payable_lines(v.journal_entry_account, v.journal_entry, v.account)
    return L.journal_class_sums(jl, v.supplier, flag, amount, out)


@q("journal_credits", _journal_sql("jl.credit > 0 AND jl.reference_type IS NULL AND jl.reference_name IS NULL", "credit", "Outstanding_From_Invoices"))
def journal_credits(v):
    return _journal(v, "is_credit", "credit", "Outstanding_From_Invoices")


@q("journal_debits_unallocated", _journal_sql("jl.debit > 0 AND jl.reference_type IS NULL", "debit", "debits_unallocated"))
def journal_debits_unallocated(v):
    return _journal(v, "is_debit_open", "debit", "debits_unallocated")


@q("journal_debits_allocated", _journal_sql("jl.debit > 0 AND jl.reference_type IS NOT NULL AND jl.reference_type <> 'Purchase Invoice'",
                                            "debit", "debits_allocated"))
def journal_debits_allocated(v):
    return _journal(v, "is_debit_alloc", "debit", "debits_allocated")


@q("net_outstanding", f"""WITH {_INV_OUT}, {_UNALLOC}
SELECT i.supplier_id, i.supplier_name, CAST(i.total_outstanding AS DOUBLE) AS Total_Outstanding,
  IFNULL(CAST(u.total_debits AS DOUBLE), 0) AS Unallocated_Amount,
  IFNULL(CAST(i.total_outstanding AS DOUBLE), 0) - IFNULL(CAST(u.total_debits AS DOUBLE), 0) AS Balance
FROM inv_out i LEFT JOIN unalloc u ON i.supplier_id = u.supplier_id""")
def net_outstanding(v):
    return L.net_outstanding(_inv_out(v), _unalloc(v))


@q("daily_target", f"""WITH {_MONTHS}
SELECT m AS month_start, {MONTHLY_TARGET} / CAST(day(last_day(m)) AS INTEGER) AS daily_sales_target FROM months""")
def daily_target(v):
    m = S.submitted(v.sales_invoice).select(F.trunc("posting_date", "MM").alias("month_start")).distinct()
    return m.select("month_start", S.daily_target(F.col("month_start"), MONTHLY_TARGET).alias("daily_sales_target"))


@q("densify_daily", f"""WITH {_DAILY}, {_MONTHS}
SELECT a.posting_date, CAST(COALESCE(d.amt, 0) AS DOUBLE) AS sales_today FROM all_days a LEFT JOIN daily d ON a.posting_date = d.posting_date""")
def densify_daily(v):
    return S.densify_daily(_sales_calendar(v), _daily(v), "amt").select("posting_date", _d("amt").alias("sales_today"))


_CASH_BASE = f"""gl.is_cancelled = 0 AND gl.posting_date {_PERIOD}
    AND gl.account NOT IN ('Suspense Account NML') AND acc.account_type IN ('Bank', 'Cash')"""


@q("cash_in_lines", f"""SELECT gl.name, gl.posting_date, gl.account, gl.debit, gl.against, cu.customer_name, gl.voucher_no
FROM "tabGL Entry" gl JOIN "tabAccount" acc ON gl.account = acc.name JOIN "tabCustomer" cu ON gl.against = cu.name
WHERE {_CASH_BASE} AND gl.voucher_subtype IN ('Journal Entry', 'Receive') AND gl.debit > 0""")
def cash_in_lines(v):
    cu = v.customer.select(F.col("name").alias("against"), "customer_name")
    return (L.cash_lines(v.gl_entry, v.account, START, END)
            .where((F.col("debit") > 0) & F.col("voucher_subtype").isin(*L.COLLECTION_SUBTYPES))
            .join(cu, "against", "inner")
            .select("name", "posting_date", "account", "debit", "against", "customer_name", "voucher_no"))


@q("cash_out_lines", f"""SELECT gl.name, gl.posting_date, gl.account, gl.credit, gl.against, sp.supplier_name, gl.voucher_no
FROM "tabGL Entry" gl JOIN "tabAccount" acc ON gl.account = acc.name JOIN "tabSupplier" sp ON gl.against = sp.name
WHERE {_CASH_BASE} AND gl.voucher_subtype IN ('Journal Entry', 'Pay') AND gl.credit > 0""")
def cash_out_lines(v):
    sp = v.supplier.select(F.col("name").alias("against"), "supplier_name")
    return (L.cash_lines(v.gl_entry, v.account, START, END)
            .where((F.col("credit") > 0) & F.col("voucher_subtype").isin(*L.PAYMENT_SUBTYPES))
            .join(sp, "against", "inner")
            .select("name", "posting_date", "account", "credit", "against", "supplier_name", "voucher_no"))


@q("payroll_suppliers", """SELECT sp.name AS supplier_id, sp.supplier_name, pa.account AS party_account, a.parent_account
FROM "tabSupplier" sp JOIN "tabParty Account" pa ON sp.name = pa.parent JOIN "tabAccount" a ON a.name = pa.account
WHERE a.parent_account LIKE '%Payroll%'""")
def payroll_suppliers(v):
    return L.payroll_suppliers(v.supplier, v.party_account, v.account)


@q("pay_category", """SELECT sp.name AS supplier_id,
  CASE WHEN a.parent_account = '2500 - Payroll Liabilities - NML' THEN 'Salary Payment' ELSE 'Supplier Payment' END AS Supplier_category
FROM "tabSupplier" sp LEFT JOIN "tabParty Account" pa ON sp.name = pa.parent LEFT JOIN "tabAccount" a ON a.name = pa.account""")
def pay_category(v):
    pa = v.party_account.select(F.col("parent").alias("supplier_id"), F.col("account").alias("party_account"))
    acc = v.account.select(F.col("name").alias("party_account"), "parent_account")
    sp = v.supplier.select(F.col("name").alias("supplier_id"))
    j = sp.join(pa, "supplier_id", "left").join(acc, "party_account", "left")
    return j.select("supplier_id", fn.pay_category("parent_account").alias("Supplier_category"))


@q("other_drawings", f"""SELECT gl.against, {dsum('gl.credit')} AS draw_amount
FROM "tabGL Entry" gl JOIN "tabAccount" acc ON gl.account = acc.name LEFT JOIN "tabSupplier" sp ON gl.against = sp.name
WHERE {_CASH_BASE} AND gl.voucher_subtype NOT IN ('Internal Transfer') AND gl.credit > 0
  AND sp.supplier_name IS NULL AND gl.against NOT IN ('04003101171250 I&M BANK KES A/C - NML')
GROUP BY gl.against""")
def other_drawings(v):
    return L.other_drawings(v.gl_entry, v.account, v.supplier, START, END)

