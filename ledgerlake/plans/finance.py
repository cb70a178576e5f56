"""Finance reports R9-R17 registered with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlake.functions import as_double, binary_text, money_sum
from ledgerlake.operators import ledger as L
from ledgerlake.operators.relational import collated_groups
from ledgerlake.plans.registry import AS_OF, COMPANY, END, START, dsum, msum, register, sql_date
from ledgerlake.sources.extract import collated_source
from ledgerlake.sources.fixtures import ErpViews

_PERIOD = f"BETWEEN {sql_date(START)} AND {sql_date(END)}"

_PAYABLE_PARTIES = f"""payable_parties AS (
  SELECT gl.party, sp.supplier_name, {msum('gl.credit')} AS cr, {msum('gl.debit')} AS dr
  FROM "tabGL Entry" gl
  JOIN "tabAccount" a ON gl.account = a.name
  LEFT JOIN "tabSupplier" sp ON gl.party = sp.name
  WHERE gl.is_cancelled = 0 AND a.account_type = 'Payable'
  GROUP BY gl.party, sp.supplier_name)"""


@register("total_owed", f"""
WITH {_PAYABLE_PARTIES},
positive AS (SELECT party, cr - dr AS bal FROM payable_parties WHERE cr - dr > 0)
SELECT CAST(SUM(bal) AS DOUBLE) AS total_owed FROM positive""")
def total_owed(spark, sf_dir):
    v = ErpViews(spark, sf_dir)
    return L.total_owed(v.gl_entry, v.account)


@register("total_owed_named", f"""
WITH {_PAYABLE_PARTIES}
SELECT CAST(SUM(cr - dr) AS DOUBLE) AS total_owed FROM payable_parties WHERE cr - dr > 0""")
def total_owed_named(spark, sf_dir):
    v = ErpViews(spark, sf_dir)
    # the named form groups by (party, name); with ``name`` unique per party
    # that is the same groups, and the sum needs no name lookup
    bal = L.party_balance(v.gl_entry, v.account, None)
    return bal.agg(L.as_double(F.sum(F.when(F.col("supplier_balances") > 0, F.col("supplier_balances"))))
                   .alias("total_owed"))


@register("party_balance", f"""
WITH {_PAYABLE_PARTIES}
SELECT party, supplier_name, CAST(cr AS DOUBLE) AS supplier_invoices, CAST(dr AS DOUBLE) AS supplier_payments,
       CAST(cr - dr AS DOUBLE) AS supplier_balances FROM payable_parties""")
def party_balance(spark, sf_dir):
    v = ErpViews(spark, sf_dir)
    b = L.party_balance(v.gl_entry, v.account, v.supplier)
    return b.select("party", "supplier_name", *[L.as_double(c).alias(c) for c in
                                                 ("supplier_invoices", "supplier_payments", "supplier_balances")])


@register("payables_journal_draft", f"""
WITH alloc AS (
  SELECT pe.party AS supplier_id, MIN(pe.party_name) AS supplier_name,
         CAST(-{msum('per.allocated_amount')} AS DOUBLE) AS sum_already_allocated
  FROM "tabPayment Entry Reference" per JOIN "tabPayment Entry" pe ON per.parent = pe.name
  WHERE per.reference_doctype = 'Journal Entry' AND pe.payment_type = 'Pay' AND pe.docstatus = 1
  GROUP BY pe.party),
ledger AS (
  SELECT gl.party AS supplier_id, MIN(sp.supplier_name) AS supplier_name,
         CAST({msum('gl.credit')} - {msum('gl.debit')} AS DOUBLE) AS bal
  FROM "tabGL Entry" gl LEFT JOIN "tabSupplier" sp ON gl.party = sp.name
  WHERE gl.docstatus = 1 AND gl.voucher_type = 'Journal Entry' AND gl.is_cancelled = 0 AND gl.party_type = 'Supplier'
  GROUP BY gl.party)
SELECT * FROM alloc UNION ALL SELECT * FROM ledger""")
def payables_journal_draft(spark, sf_dir):
    v = ErpViews(spark, sf_dir)
    return L.payables_journal_draft(v.gl_entry, v.supplier, v.payment_entry_reference, v.payment_entry)


_BUCKET_SQL = [("0-30", "age BETWEEN 0 AND 30"), ("31-60", "age BETWEEN 31 AND 60"), ("61-90", "age BETWEEN 61 AND 90"),
               ("91-120", "age BETWEEN 91 AND 120"), ("121-Above", "age >= 121")]

_JOURNAL_LINES = """journal_lines AS (
  SELECT jea.party, sp.supplier_name, jea.debit, jea.credit, jea.reference_type, jea.reference_name
  FROM "tabJournal Entry Account" jea
  JOIN "tabJournal Entry" je ON jea.parent = je.name
  JOIN "tabAccount" acc ON jea.account = acc.name
  LEFT JOIN "tabSupplier" sp ON jea.party = sp.name
  WHERE jea.docstatus = 1 AND je.docstatus = 1 AND jea.party_type = 'Supplier'
    AND je.is_system_generated = 0 AND acc.account_type = 'Payable')"""

_AS_OF_AGE = f"date_diff('day', due_date, {sql_date(AS_OF)})"

_PAYABLES_AGEING = f"""
WITH open_inv AS (
  SELECT supplier AS supplier_id, supplier_name,
         CASE WHEN party_account_currency = 'USD' THEN outstanding_amount * conversion_rate ELSE outstanding_amount END AS amt,
         {_AS_OF_AGE} AS age
  FROM "tabPurchase Invoice"
  WHERE docstatus = 1 AND status NOT IN ('Paid', 'Return') AND {_AS_OF_AGE} >= 0),
inv_ageing AS (
  SELECT supplier_id, MIN(supplier_name) AS supplier_name,
         {", ".join(f'COALESCE(SUM(CASE WHEN {cond} THEN CAST(amt AS DECIMAL(18,4)) ELSE 0 END), 0) AS "{lab}"' for lab, cond in _BUCKET_SQL)},
         {msum('amt')} AS outstanding
  FROM open_inv GROUP BY supplier_id),
{_JOURNAL_LINES},
journal_credit AS (
  SELECT party AS supplier_id, MIN(supplier_name) AS supplier_name, 0, 0, 0, 0, 0, {msum('credit')} AS outstanding
  FROM journal_lines WHERE credit > 0 AND reference_type IS NULL AND reference_name IS NULL GROUP BY party),
credit_side AS (
  SELECT supplier_id, MIN(supplier_name) AS supplier_name,
         {", ".join(f'SUM("{lab}") AS "{lab}"' for lab, _ in _BUCKET_SQL)},
         SUM(outstanding) AS total_outstanding
  FROM (SELECT * FROM inv_ageing UNION ALL SELECT * FROM journal_credit) u GROUP BY supplier_id),
debit_parts AS (
  SELECT party AS supplier_id, {msum('base_paid_amount - base_total_allocated_amount')} AS amt
    FROM "tabPayment Entry"
    WHERE docstatus = 1 AND payment_type = 'Pay' AND party_type = 'Supplier'
      AND base_paid_amount - base_total_allocated_amount > 0 GROUP BY party
  UNION ALL SELECT party, {msum('debit')} FROM journal_lines WHERE debit > 0 AND reference_type IS NULL GROUP BY party
  UNION ALL SELECT party, {msum('debit')} FROM journal_lines
    WHERE debit > 0 AND reference_type IS NOT NULL AND reference_type <> 'Purchase Invoice' GROUP BY party
  UNION ALL SELECT pe.party, {msum('per.allocated_amount')}
    FROM "tabPayment Entry Reference" per JOIN "tabPayment Entry" pe ON per.parent = pe.name
    WHERE per.reference_doctype = 'Journal Entry' AND pe.payment_type = 'Pay' AND pe.docstatus = 1 AND pe.party_type = 'Supplier'
    GROUP BY pe.party),
debit_side AS (SELECT supplier_id, SUM(amt) AS total_debits FROM debit_parts GROUP BY supplier_id)
SELECT c.supplier_id, c.supplier_name,
       {", ".join(f'CAST(c."{lab}" AS DOUBLE) AS "{lab}"' for lab, _ in _BUCKET_SQL)},
       CAST(COALESCE(d.total_debits, 0) AS DOUBLE) AS Unallocated_Amount,
       CAST(c.total_outstanding AS DOUBLE) AS Total_Outstanding,
       CAST(COALESCE(c.total_outstanding, 0) - COALESCE(d.total_debits, 0) AS DOUBLE) AS Balance
FROM credit_side c LEFT JOIN debit_side d ON c.supplier_id = d.supplier_id
WHERE COALESCE(c.total_outstanding, 0) - COALESCE(d.total_debits, 0) > 0
ORDER BY Balance DESC"""


@register("payables_ageing", _PAYABLES_AGEING)
def payables_ageing(spark, sf_dir):
    v = ErpViews(spark, sf_dir)
    return L.payables_ageing(v.purchase_invoice, v.journal_entry_account, v.journal_entry, v.account, v.supplier,
                             v.payment_entry, v.payment_entry_reference, AS_OF)


@register("customer_balance", f"""
SELECT party, MIN(transaction_currency) AS transaction_currency,
       CAST({msum('debit_in_transaction_currency')} - {msum('credit_in_transaction_currency')} AS DOUBLE) AS balance
FROM "tabGL Entry" WHERE is_cancelled = 0 GROUP BY party""")
def customer_balance(spark, sf_dir):
    return L.party_currency_balance(ErpViews(spark, sf_dir).gl_entry)


@register("customer_balance_by_currency", f"""
SELECT party, transaction_currency,
       CAST({msum('debit_in_transaction_currency')} - {msum('credit_in_transaction_currency')} AS DOUBLE) AS balance
FROM "tabGL Entry" WHERE is_cancelled = 0 GROUP BY party, transaction_currency""")
def customer_balance_by_currency(spark, sf_dir):
    return L.party_currency_balance(ErpViews(spark, sf_dir).gl_entry, by_currency=True)


_CASH_BASE = f"""gl.is_cancelled = 0 AND gl.posting_date {_PERIOD}
    AND gl.account NOT IN ('Suspense Account NML') AND acc.account_type IN ('Bank', 'Cash')"""

_COLLECTIONS = f"""collections AS (
  SELECT gl.account AS account_name, {msum('gl.debit')} AS amt
  FROM "tabGL Entry" gl JOIN "tabAccount" acc ON gl.account = acc.name
  JOIN "tabCustomer" cu ON gl.against = cu.name
  WHERE {_CASH_BASE} AND gl.voucher_subtype IN ('Journal Entry', 'Receive') AND gl.debit > 0
  GROUP BY gl.account)"""


@register("cash_received", f"""
WITH {_COLLECTIONS}
SELECT account_name, CAST(amt AS DOUBLE) AS money_in FROM collections""")
def cash_received(spark, sf_dir):
    v = ErpViews(spark, sf_dir)
    return L.cash_received(v.gl_entry, v.account, v.customer, START, END)


@register("cash_paid", f"""
SELECT gl.posting_date, gl.account, gl.debit, gl.credit, gl.against, gl.party_type, sp.supplier_name,
       acc.parent_account, gl.voucher_type, gl.voucher_no, gl.voucher_subtype, gl.against_voucher_type, gl.against_voucher
FROM "tabGL Entry" gl JOIN "tabAccount" acc ON gl.account = acc.name
JOIN "tabSupplier" sp ON gl.against = sp.name
WHERE {_CASH_BASE} AND gl.voucher_subtype IN ('Journal Entry', 'Pay') AND gl.credit > 0""")
def cash_paid(spark, sf_dir):
    v = ErpViews(spark, sf_dir)
    return L.cash_paid(v.gl_entry, v.account, v.supplier, START, END)


_CASH_FLOW = f"""{_COLLECTIONS},
payroll AS (
  SELECT sp.name AS supplier_id, a.parent_account
  FROM "tabSupplier" sp JOIN "tabParty Account" pa ON sp.name = pa.parent
  JOIN "tabAccount" a ON a.name = pa.account
  WHERE a.parent_account LIKE '%Payroll%'),
payments AS (
  SELECT gl.credit,
         CASE WHEN pr.parent_account = '2500 - Payroll Liabilities - NML' THEN 'Salary Payment' ELSE 'Supplier Payment' END AS category
  FROM "tabGL Entry" gl JOIN "tabAccount" acc ON gl.account = acc.name
  JOIN "tabSupplier" sp ON gl.against = sp.name
  LEFT JOIN payroll pr ON gl.against = pr.supplier_id
  WHERE {_CASH_BASE} AND gl.voucher_subtype IN ('Journal Entry', 'Pay') AND gl.credit > 0),
drawings AS (
  SELECT gl.against, {msum('gl.credit')} AS amt
  FROM "tabGL Entry" gl JOIN "tabAccount" acc ON gl.account = acc.name
  LEFT JOIN "tabSupplier" sp ON gl.against = sp.name
  WHERE {_CASH_BASE} AND gl.voucher_subtype NOT IN ('Internal Transfer') AND gl.credit > 0
    AND sp.supplier_name IS NULL AND gl.against NOT IN ('04003101171250 I&M BANK KES A/C - NML')
  GROUP BY gl.against),
flows AS (
  SELECT 'Cash From Collections' AS Cash_Flow_Category, account_name, amt FROM collections
  UNION ALL SELECT 'Cash Outflow', category, {msum('credit')} FROM payments GROUP BY category
  UNION ALL SELECT 'Other drawings', against, amt FROM drawings)"""


@register("cash_flow", f"""
WITH {_CASH_FLOW}
SELECT Cash_Flow_Category, account_name, CAST(amt AS DOUBLE) AS amount FROM flows""")
def cash_flow(spark, sf_dir):
    v = ErpViews(spark, sf_dir)
    return L.cash_flow(v.gl_entry, v.account, v.customer, v.supplier, v.party_account, START, END)


@register("cash_flow_totals", f"""
WITH {_CASH_FLOW}
SELECT 'Balance/Deficit' AS Totals,
       CAST(SUM(CASE WHEN Cash_Flow_Category = 'Cash From Collections' THEN amt ELSE 0 END) AS DOUBLE) AS collections,
       CAST(SUM(CASE WHEN Cash_Flow_Category = 'Cash Outflow' THEN amt ELSE 0 END) AS DOUBLE) AS Supplier_payments,
       CAST(SUM(CASE WHEN Cash_Flow_Category = 'Other drawings' THEN amt ELSE 0 END) AS DOUBLE) AS other_drawings
FROM flows GROUP BY 1""")
def cash_flow_totals(spark, sf_dir):
    v = ErpViews(spark, sf_dir)
    return L.cash_flow_totals(v.gl_entry, v.account, v.customer, v.supplier, v.party_account, START, END)


_PNL = f"""pnl AS (
  SELECT acc.parent_account,
         SUM(CASE WHEN acc.root_type = 'Expense' THEN CAST(gl.debit AS DECIMAL(18,4)) - CAST(gl.credit AS DECIMAL(18,4)) END) AS expenses,
         SUM(CASE WHEN acc.root_type = 'Income' THEN CAST(gl.credit AS DECIMAL(18,4)) - CAST(gl.debit AS DECIMAL(18,4)) END) AS income
  FROM "tabGL Entry" gl JOIN "tabAccount" acc ON gl.account = acc.name
  WHERE acc.root_type IN ('Income', 'Expense') AND gl.is_cancelled = 0 AND gl.posting_date {_PERIOD}
  GROUP BY acc.parent_account)"""


@register("net_profit", f"""
WITH {_PNL}
SELECT MAX('{COMPANY}') AS company, 'Net Profit' AS Account, CAST(SUM(income) - SUM(expenses) AS DOUBLE) AS Net_Profit,
       '' AS Account_type FROM pnl""")
def net_profit(spark, sf_dir):
    v = ErpViews(spark, sf_dir)
    return L.net_profit(v.gl_entry, v.account, START, END, COMPANY)


@register("income_expense", f"""
WITH {_PNL}
SELECT parent_account, CAST(expenses AS DOUBLE) AS total_expenses, CAST(income AS DOUBLE) AS total_income FROM pnl""")
def income_expense(spark, sf_dir):
    v = ErpViews(spark, sf_dir)
    return L.income_expense(v.gl_entry, v.account, START, END)


# ---------------------------------------------------------------- K12: names compared without regard to case

def _shouted(c: str) -> str:
    return f"CASE WHEN length(name) % 2 = 0 THEN upper({c}) ELSE {c} END AS {c}"


_MIXED = {
    "tabGL Entry": ["name", "posting_date", "debit", "credit", "is_cancelled",
                    *map(_shouted, ("account", "against", "voucher_subtype"))],
    "tabAccount": ["name", *map(_shouted, ("account_type", "root_type", "parent_account"))],
    "tabCustomer": ["lower(name) AS name"],
}
_MIXED_SQL = ", ".join(f'{t} AS (SELECT {", ".join(_MIXED[name])} FROM "{name}")' for t, name in (
    ("gl", "tabGL Entry"), ("acc", "tabAccount"), ("cu", "tabCustomer")))


def _mixed_case(v: ErpViews):
    """ERP tables whose spelling varies from row to row, under the case-insensitive collation."""
    return collated_source(lambda t: v[t].selectExpr(*_MIXED[t]))


@register("income_expense_collated", f"""
WITH {_MIXED_SQL}
SELECT lower(acc.parent_account) AS parent_account,
       CAST(SUM(CASE WHEN lower(root_type) = 'expense' THEN CAST(debit AS DECIMAL(18,4)) - CAST(credit AS DECIMAL(18,4)) END) AS DOUBLE) AS total_expenses,
       CAST(SUM(CASE WHEN lower(root_type) = 'income' THEN CAST(credit AS DECIMAL(18,4)) - CAST(debit AS DECIMAL(18,4)) END) AS DOUBLE) AS total_income
FROM gl JOIN acc ON lower(gl.account) = lower(acc.name)
WHERE lower(root_type) IN ('income', 'expense') AND is_cancelled = 0 AND posting_date {_PERIOD}
GROUP BY lower(acc.parent_account)""")
def income_expense_collated(spark, sf_dir):
    src = _mixed_case(ErpViews(spark, sf_dir))
    out = L.income_expense(src("tabGL Entry"), src("tabAccount"), START, END)
    return binary_text(out.withColumn("parent_account", F.lower("parent_account")))


@register("cash_received_collated", f"""
WITH {_MIXED_SQL}
SELECT lower(gl.account) AS account_name, {dsum('debit')} AS money_in
FROM gl JOIN acc ON lower(gl.account) = lower(acc.name)
WHERE is_cancelled = 0 AND posting_date {_PERIOD} AND lower(gl.account) <> 'suspense account nml'
  AND lower(account_type) IN ('bank', 'cash') AND lower(voucher_subtype) IN ('journal entry', 'receive') AND debit > 0
  AND lower(against) IN (SELECT lower(name) FROM cu)
GROUP BY lower(gl.account)""")
def cash_received_collated(spark, sf_dir):
    src = _mixed_case(ErpViews(spark, sf_dir))
    out = L.cash_received(src("tabGL Entry"), src("tabAccount"), src("tabCustomer"), START, END)
    return binary_text(out.withColumn("account_name", F.lower("account_name")))


@register("against_sums_collated", f"""
WITH {_MIXED_SQL}
SELECT MIN(against) AS against, {dsum('debit')} AS debit, {dsum('credit')} AS credit
FROM gl GROUP BY lower(against)""")
def against_sums_collated(spark, sf_dir):
    gl = _mixed_case(ErpViews(spark, sf_dir))("tabGL Entry")
    sums = collated_groups(gl, ["against"], {"debit": money_sum("debit"), "credit": money_sum("credit")})
    return sums.select("against", *[as_double(c).alias(c) for c in ("debit", "credit")])
