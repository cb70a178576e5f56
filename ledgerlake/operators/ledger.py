"""Ledger, payables and cash operators (D8-D13, D19-D24; R9-R17).

Design rules, all for scale:

* ``name`` is the primary key of every ERP table.  A join on it never fans
  out, so joins that only test existence are semi/anti joins, and joins that
  only fetch a display name run *after* aggregation (one row per party
  instead of one per ledger row; a party holding a third of the ledger is
  pre-summed map-side and never crosses the network as raw rows).
* Several reports read the same source with different filters and re-sum
  unions of partial sums.  Sums are associative, so each is one classified
  pass: rows get class columns, then one aggregation per output key.
* Amounts are summed as DECIMAL(18,4), cast to double at the end.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from ledgerlake.functions import as_double, date_in_period, exact_sum, money, money_sum, to_base_currency
from ledgerlake.functions.dates import as_date
from ledgerlake.functions.erp import PAYROLL_PARENT, PAYROLL_PATTERN
from ledgerlake.functions.money import AMOUNT
from ledgerlake.operators.relational import group_by_constant, sums_with_min_text

# Fixed values of the source reports.
AGEING_BUCKETS = (("0-30", 0, 30), ("31-60", 31, 60), ("61-90", 61, 90), ("91-120", 91, 120), ("121-Above", 121, None))
SETTLED_INVOICE_STATES = ("Paid", "Return")
BANK_ACCOUNT_TYPES = ("Bank", "Cash")
SKIPPED_BANK_ACCOUNTS = ("Suspense Account NML",)
COLLECTION_SUBTYPES = ("Journal Entry", "Receive")
PAYMENT_SUBTYPES = ("Journal Entry", "Pay")
TRANSFER_SUBTYPES = ("Internal Transfer",)
OWN_BANK_COUNTERPARTIES = ("04003101171250 I&M BANK KES A/C - NML",)
CAT_COLLECTIONS = "Cash From Collections"
CAT_OUTFLOW = "Cash Outflow"
CAT_DRAWINGS = "Other drawings"

_DEC = DecimalType(38, 4)


def _zero() -> Column:
    return F.lit(0).cast(_DEC)


def submitted(df: DataFrame) -> DataFrame:
    return df.where(F.col("docstatus") == 1)


def not_cancelled(df: DataFrame) -> DataFrame:
    return df.where(F.col("is_cancelled") == 0)


def accounts_of_type(account: DataFrame, *types: str, column: str = "account_type") -> DataFrame:
    return account.where(F.col(column).isin(*types))


def with_supplier_name(df: DataFrame, supplier: DataFrame, key: str = "party",
                       out: str = "supplier_name") -> DataFrame:
    """Left lookup of the supplier's name by its unique ``name``."""
    sp = supplier.select(F.col("name").alias(key), F.col("supplier_name").alias(out))
    return df.join(sp, key, "left")


# --------------------------------------------------------------------------
# Balances per party on accounts of one type
# --------------------------------------------------------------------------

def party_balance(gl_entry: DataFrame, account: DataFrame, supplier: DataFrame | None,
                  account_type: str = "Payable") -> DataFrame:
    """Per party, credits and debits on non-cancelled entries of the
    account type, and credits - debits (exact decimals).  The supplier name
    is looked up on the aggregate (skipped when ``supplier`` is None)."""
    acc = accounts_of_type(account, account_type).select(F.col("name").alias("account"))
    rows = not_cancelled(gl_entry).join(acc, "account", "left_semi")
    per_party = rows.groupBy("party").agg(money_sum("credit").alias("supplier_invoices"),
                                          money_sum("debit").alias("supplier_payments"))
    per_party = per_party.withColumn("supplier_balances",
                                     F.col("supplier_invoices") - F.col("supplier_payments"))
    if supplier is None:
        return per_party
    return with_supplier_name(per_party, supplier).select(
        "party", "supplier_name", "supplier_invoices", "supplier_payments", "supplier_balances")


def total_owed(gl_entry, account, account_type: str = "Payable") -> DataFrame:
    """The sum of the positive party balances (one row, NULL if none).
    The names are not needed for the sum, so no lookup is made."""
    bal = party_balance(gl_entry, account, None, account_type)
    return bal.where(F.col("supplier_balances") > 0).agg(as_double(F.sum("supplier_balances")).alias("total_owed"))


# --------------------------------------------------------------------------
# Payment and journal sources of the payables reports
# --------------------------------------------------------------------------

def supplier_payments(payment_entry: DataFrame, party_type: str = "Supplier") -> DataFrame:
    """Submitted outgoing payments to parties of the type."""
    return submitted(payment_entry).where(
        (F.col("payment_type") == "Pay") & (F.col("party_type") == party_type))


def unallocated_payments(payment_entry: DataFrame, party_type: str = "Supplier") -> DataFrame:
    """Per party, paid minus allocated over payments with a positive rest."""
    rest = F.col("base_paid_amount") - F.col("base_total_allocated_amount")
    rows = supplier_payments(payment_entry, party_type).where(rest > 0).select(
        F.col("party").alias("supplier_id"), "party_name", rest.alias("rest"))
    return sums_with_min_text(rows, ["supplier_id"], {"amt": money_sum("rest")}, "party_name", "supplier_name").select(
        "supplier_id", "supplier_name", as_double("amt").alias("total_unallocated_amount"))


def allocated_payment_rows(payment_entry_reference: DataFrame, payment_entry: DataFrame,
                           party_type: str | None = "Supplier", doctype: str = "Journal Entry") -> DataFrame:
    """References of outgoing payments that settle documents of ``doctype``.
    ``party_type=None`` keeps every party (the draft report's form)."""
    pe = submitted(payment_entry).where(F.col("payment_type") == "Pay")
    if party_type is not None:
        pe = pe.where(F.col("party_type") == party_type)
    pe = pe.select(F.col("name").alias("parent"), "party", "party_name")
    per = payment_entry_reference.where(F.col("reference_doctype") == doctype).select("parent", "allocated_amount")
    return per.join(pe, "parent", "inner")


def allocated_payments(payment_entry_reference, payment_entry, party_type: str | None = "Supplier") -> DataFrame:
    """Per party, amounts of payments allocated to journal entries."""
    rows = allocated_payment_rows(payment_entry_reference, payment_entry, party_type).withColumnRenamed(
        "party", "supplier_id")
    return sums_with_min_text(rows, ["supplier_id"], {"amt": money_sum("allocated_amount")}, "party_name",
                              "supplier_name").select("supplier_id", "supplier_name",
                                                      as_double("amt").alias("debits_allocated"))


def journal_payable_lines(journal_entry_account: DataFrame, journal_entry: DataFrame, account: DataFrame,
                          party_type: str = "Supplier", account_type: str = "Payable") -> DataFrame:
    """Submitted, manual journal lines of the party type on accounts of the
    type, with three class flags (D12):

    * ``is_credit``: credited, no reference at all (new liability),
    * ``is_debit_open``: debited without a reference type (unallocated),
    * ``is_debit_alloc``: debited against something other than an invoice.
    """
    je = submitted(journal_entry).where(F.col("is_system_generated") == 0).select(F.col("name").alias("parent"))
    acc = accounts_of_type(account, account_type).select(F.col("name").alias("account"))
    jea = (submitted(journal_entry_account).where(F.col("party_type") == party_type)
           .join(acc, "account", "left_semi")
           .join(je, "parent", "left_semi"))
    ref_t, ref_n = F.col("reference_type"), F.col("reference_name")
    return jea.select(
        "name", "parent", "party", "account", "debit", "credit", "reference_type", "reference_name",
        ((F.col("credit") > 0) & ref_t.isNull() & ref_n.isNull()).alias("is_credit"),
        ((F.col("debit") > 0) & ref_t.isNull()).alias("is_debit_open"),
        ((F.col("debit") > 0) & ref_t.isNotNull() & (ref_t != "Purchase Invoice")).alias("is_debit_alloc"))


def outstanding_in_base(purchase_invoice: DataFrame, foreign: str = "USD") -> DataFrame:
    """Outstanding amount of each supplier's submitted invoices in base currency, products and sum exact to
    nine decimals (``functions.money.exact_sum``)."""
    factor = F.when(F.col("party_account_currency") == foreign, F.col("conversion_rate").cast(AMOUNT)).otherwise(F.lit(1))
    return (submitted(purchase_invoice).groupBy(F.col("supplier").alias("supplier_id"))
            .agg(exact_sum("outstanding_amount", factor).alias("outstanding")))


def journal_class_sums(lines: DataFrame, supplier: DataFrame, flag: str, amount: str, out: str) -> DataFrame:
    """Sum of one class of journal lines per party, with the supplier name."""
    per = (lines.where(F.col(flag)).groupBy(F.col("party"))
           .agg(as_double(money_sum(amount)).alias(out)))
    return with_supplier_name(per, supplier).select(F.col("party").alias("supplier_id"), "supplier_name", out)


# --------------------------------------------------------------------------
# Payables ageing
# --------------------------------------------------------------------------

def open_invoices(purchase_invoice: DataFrame, as_of=None, settled=SETTLED_INVOICE_STATES) -> DataFrame:
    """Submitted, unsettled invoices already due on ``as_of``, in base
    currency, with their age in days past the due date.  The due-date bound
    is on the raw column, so it reaches the scan."""
    age = F.datediff(as_date(as_of), F.col("due_date"))
    return (submitted(purchase_invoice).where(~F.col("status").isin(*settled)
                                             & (F.col("due_date") <= as_date(as_of)))
            .select(F.col("supplier").alias("supplier_id"), "supplier_name",
                    to_base_currency("outstanding_amount", "party_account_currency", "conversion_rate").alias("amount"),
                    age.alias("age_days")))


def bucket_columns(age: Column, amount: Column, buckets=AGEING_BUCKETS) -> list[Column]:
    """One exact amount column per inclusive age bucket (0 outside it)."""
    out = []
    for label, lo, hi in buckets:
        inside = (age >= lo) if hi is None else age.between(lo, hi)
        out.append(F.when(inside, money(amount)).otherwise(_zero()).alias(label))
    return out


def ageing_buckets(df: DataFrame, by: str, age: str, amount: str, buckets=AGEING_BUCKETS) -> DataFrame:
    """Per key, amounts by age bucket (one pass, conditional sums) and
    the total."""
    cols = bucket_columns(F.col(age), F.col(amount), buckets)
    labels = [b[0] for b in buckets]
    return (df.select(by, *cols, money(amount).alias("__amt"))
            .groupBy(by)
            .agg(*[as_double(F.coalesce(F.sum(F.col(f"`{lab}`")), _zero())).alias(lab) for lab in labels],
                 as_double(F.sum("__amt")).alias("Outstanding_From_Invoices")))


def payables_ageing(purchase_invoice, journal_entry_account, journal_entry, account, supplier,
                    payment_entry, payment_entry_reference, as_of, buckets=AGEING_BUCKETS) -> DataFrame:
    """Per supplier with credits, the invoice ageing buckets, all
    debits (``Unallocated_Amount``), all credits (``Total_Outstanding``) and
    the balance; positive balances only, largest first.

    Credits are open invoices (bucketed) and unreferenced journal credits
    (not bucketed, so the buckets need not add up to the total).  Debits are
    unallocated payments and all journal debits and payment allocations to
    journal entries.  A supplier with debits only is not listed.

    One pass: every source row is put in a common shape with class columns,
    the union is aggregated by supplier (partial sums before the shuffle),
    and the supplier names are looked up on the aggregate.
    """
    labels = [b[0] for b in buckets]
    zeros = [_zero().alias(lab) for lab in labels]
    none = F.lit(None).cast(_DEC)

    inv = open_invoices(purchase_invoice, as_of)
    credit_inv = inv.select(
        "supplier_id", F.col("supplier_name").alias("inv_name"),
        *bucket_columns(F.col("age_days"), F.col("amount"), buckets),
        money("amount").alias("outstanding"), none.alias("debit"),
        F.lit(True).alias("is_credit"), F.lit(False).alias("jl_credit"))

    jl = journal_payable_lines(journal_entry_account, journal_entry, account).where(
        F.col("is_credit") | F.col("is_debit_open") | F.col("is_debit_alloc"))
    journal = jl.select(
        F.col("party").alias("supplier_id"), F.lit(None).cast("string").alias("inv_name"), *zeros,
        F.when(F.col("is_credit"), money("credit")).alias("outstanding"),
        F.when(F.col("is_debit_open") | F.col("is_debit_alloc"), money("debit")).alias("debit"),
        F.col("is_credit"), F.col("is_credit").alias("jl_credit"))

    pay = supplier_payments(payment_entry)
    rest = F.col("base_paid_amount") - F.col("base_total_allocated_amount")
    unalloc = pay.where(rest > 0).select(
        F.col("party").alias("supplier_id"), F.lit(None).cast("string").alias("inv_name"), *zeros,
        none.alias("outstanding"), money(rest).alias("debit"), F.lit(False).alias("is_credit"),
        F.lit(False).alias("jl_credit"))

    alloc = allocated_payment_rows(payment_entry_reference, payment_entry).select(
        F.col("party").alias("supplier_id"), F.lit(None).cast("string").alias("inv_name"), *zeros,
        none.alias("outstanding"), money("allocated_amount").alias("debit"), F.lit(False).alias("is_credit"),
        F.lit(False).alias("jl_credit"))

    rows = reduce(DataFrame.union, [credit_inv, journal, unalloc, alloc])
    # Two-step aggregate, one pass over the sources: first by (supplier,
    # invoice name) with fixed-width buffers only (hash aggregation, partial
    # sums before the shuffle), then by supplier, where the text MIN sees a
    # handful of rows per supplier instead of every invoice.  Sums of exact
    # decimal sums are the same sums.
    by_name = rows.groupBy("supplier_id", "inv_name").agg(
        F.max("is_credit").alias("is_credit"), F.max("jl_credit").alias("jl_credit"),
        *[F.sum(F.col(f"`{lab}`")).alias(lab) for lab in labels],
        F.sum("outstanding").alias("outstanding"), F.sum("debit").alias("debit"))
    agg = by_name.groupBy("supplier_id").agg(
        F.max("is_credit").alias("has_credit"),
        F.max("jl_credit").alias("has_journal_credit"),
        F.min("inv_name").alias("inv_name"),
        *[F.sum(F.col(f"`{lab}`")).alias(lab) for lab in labels],
        F.sum("outstanding").alias("total_outstanding"),
        F.sum("debit").alias("total_debits"))
    # a NULL supplier has credits but no debits: the source joins the two
    # sides on supplier_id, and NULL never matches
    debits = F.when(F.col("supplier_id").isNotNull(), F.coalesce(F.col("total_debits"), _zero())).otherwise(_zero())
    balance = F.coalesce(F.col("total_outstanding"), _zero()) - debits
    credited = agg.where(F.col("has_credit"))
    named = with_supplier_name(credited, supplier, key="supplier_id", out="journal_name")
    name = F.least(F.col("inv_name"), F.when(F.col("has_journal_credit"), F.col("journal_name")))
    return (named.select(
        "supplier_id", name.alias("supplier_name"),
        *[as_double(F.coalesce(F.col(f"`{lab}`"), _zero())).alias(lab) for lab in labels],
        as_double(debits).alias("Unallocated_Amount"),
        as_double("total_outstanding").alias("Total_Outstanding"),
        balance.alias("__balance"))
        .where(F.col("__balance") > 0)
        .orderBy(F.desc_nulls_last("__balance"))
        .select("supplier_id", "supplier_name", *[F.col(f"`{lab}`") for lab in labels],
                "Unallocated_Amount", "Total_Outstanding", as_double("__balance").alias("Balance")))


def net_outstanding(credits: DataFrame, debits: DataFrame) -> DataFrame:
    """Credits per supplier minus debits per supplier (left join on the
    supplier: a supplier with debits only is not listed)."""
    j = credits.join(debits.select("supplier_id", "total_debits"), "supplier_id", "left")
    unalloc = F.coalesce(F.col("total_debits"), F.lit(0.0))
    return j.select("supplier_id", "supplier_name", "Total_Outstanding", unalloc.alias("Unallocated_Amount"),
                    (F.coalesce(F.col("Total_Outstanding"), F.lit(0.0)) - unalloc).alias("Balance"))


def payables_journal_draft(gl_entry, supplier, payment_entry_reference, payment_entry) -> DataFrame:
    """R10 (draft): payments allocated to journal entries, negated, per
    party (any party type), stacked on the journal-voucher balance
    (credits - debits) per supplier party from the ledger."""
    rows = allocated_payment_rows(payment_entry_reference, payment_entry, party_type=None).withColumnRenamed(
        "party", "supplier_id")
    alloc = sums_with_min_text(rows, ["supplier_id"], {"amt": money_sum("allocated_amount")}, "party_name",
                               "supplier_name").select("supplier_id", "supplier_name",
                                                       as_double(-F.col("amt")).alias("sum_already_allocated"))
    gl = (submitted(not_cancelled(gl_entry))
          .where((F.col("voucher_type") == "Journal Entry") & (F.col("party_type") == "Supplier"))
          .groupBy("party").agg(as_double(money_sum("credit") - money_sum("debit")).alias("balance")))
    gl = with_supplier_name(gl, supplier).select(F.col("party").alias("supplier_id"), "supplier_name", "balance")
    return alloc.union(gl)


# --------------------------------------------------------------------------
# Party balance in transaction currency
# --------------------------------------------------------------------------

def party_currency_balance(gl_entry: DataFrame, party: str | None = None, by_currency: bool = False) -> DataFrame:
    """Debits - credits in transaction currency per party (optionally
    one party).  Summing mixed currencies is what the source does; use
    ``by_currency=True`` for one row per party and currency."""
    rows = not_cancelled(gl_entry)
    if party is not None:
        rows = rows.where(F.col("party") == party)
    bal = as_double(money_sum("debit_in_transaction_currency") - money_sum("credit_in_transaction_currency"))
    if by_currency:
        return rows.groupBy("party", "transaction_currency").agg(bal.alias("balance"))
    sums = {"dr": money_sum("debit_in_transaction_currency"), "cr": money_sum("credit_in_transaction_currency")}
    return sums_with_min_text(rows, ["party"], sums, "transaction_currency").select(
        "party", "transaction_currency", as_double(F.col("dr") - F.col("cr")).alias("balance"))


# --------------------------------------------------------------------------
# Cash in and out of bank and cash accounts
# --------------------------------------------------------------------------

def cash_lines(gl_entry: DataFrame, account: DataFrame, start, end,
               skip_accounts=SKIPPED_BANK_ACCOUNTS) -> DataFrame:
    """Non-cancelled ledger rows of the period on bank and cash
    accounts (except the skipped ones), with the bank account's parent."""
    banks = accounts_of_type(account, *BANK_ACCOUNT_TYPES).select(
        F.col("name").alias("account"), F.col("parent_account"))
    rows = (not_cancelled(gl_entry)
            .where(date_in_period("posting_date", start, end) & ~F.col("account").isin(*skip_accounts)))
    return rows.join(banks, "account", "inner")


def payroll_suppliers(supplier: DataFrame, party_account: DataFrame, account: DataFrame,
                      pattern: str = PAYROLL_PATTERN) -> DataFrame:
    """(supplier, party account, its parent) for party accounts whose
    parent account matches the payroll pattern; a supplier may have several."""
    acc = account.where(F.col("parent_account").like(pattern)).select(
        F.col("name").alias("party_account"), "parent_account")
    pa = party_account.select(F.col("parent").alias("supplier_id"), F.col("account").alias("party_account"))
    sp = supplier.select(F.col("name").alias("supplier_id"), "supplier_name")
    return sp.join(pa, "supplier_id", "inner").join(acc, "party_account", "inner").select(
        "supplier_id", "supplier_name", "party_account", "parent_account")


def counterparty_flags(customer: DataFrame, supplier: DataFrame, party_account: DataFrame,
                       account: DataFrame, payroll_parent: str = PAYROLL_PARENT) -> list[DataFrame]:
    """Per counterparty name (``against``): is it a customer; is it a supplier
    and does it have a name; how many payroll accounts it has, split into the
    exact payroll parent and other payroll parents.  Each frame has one row
    per name (``name`` is the key; payroll counts are aggregated first), so
    joining them to ledger lines never repeats a line.

    The payroll counts replace a join that would repeat each payment once
    per payroll account: a payment adds ``credit * count`` to each category,
    the same sum without materialising the copies."""
    cust = customer.select(F.col("name").alias("against"), F.lit(1).alias("is_customer"))
    supp = supplier.select(F.col("name").alias("against"), F.lit(1).alias("is_supplier"),
                           F.col("supplier_name").isNotNull().cast("int").alias("named_supplier"))
    acc = account.where(F.col("parent_account").like(PAYROLL_PATTERN)).select(
        F.col("name").alias("account"), "parent_account")
    pay = (party_account.join(acc, "account", "inner").groupBy(F.col("parent").alias("against"))
           .agg(F.sum((F.col("parent_account") == payroll_parent).cast("int")).alias("n_salary"),
                F.sum((F.col("parent_account") != payroll_parent).cast("int")).alias("n_other")))
    return [cust, supp, pay]


def classified_cash(gl_entry, account, customer, supplier, party_account, start, end,
                    collection_subtypes=COLLECTION_SUBTYPES, payment_subtypes=PAYMENT_SUBTYPES,
                    transfer_subtypes=TRANSFER_SUBTYPES, own_banks=OWN_BANK_COUNTERPARTIES,
                    payroll_parent: str = PAYROLL_PARENT) -> DataFrame:
    """Cash of the period by (against, account, class), with the counterparty's
    flags and one boolean per cash-flow class.

    Lines are summed before the three lookups join on ``against``, so a
    counterparty with a third of the ledger crosses as a few sums: a class is
    decided by the line's own columns and the flags of its counterparty, which
    are one row per name."""
    sub = F.col("voucher_subtype")

    def sure(c: Column) -> Column:
        return F.coalesce(c, F.lit(False))

    lines = cash_lines(gl_entry, account, start, end).select(
        "against", "account", "debit", "credit",
        sure((F.col("debit") > 0) & sub.isin(*collection_subtypes)).alias("line_in"),
        sure((F.col("credit") > 0) & sub.isin(*payment_subtypes)).alias("line_out"),
        sure((F.col("credit") > 0) & ~sub.isin(*transfer_subtypes)
             & ~F.col("against").isin(*own_banks)).alias("line_drawn"))
    j = (lines.where(F.col("line_in") | F.col("line_out") | F.col("line_drawn"))
         .groupBy("against", "account", "line_in", "line_out", "line_drawn")
         .agg(money_sum("debit").alias("debit"), money_sum("credit").alias("credit")))
    for flags in counterparty_flags(customer, supplier, party_account, account, payroll_parent):
        j = j.join(flags, "against", "left")
    return j.select(
        "*",
        (F.col("line_in") & (F.coalesce("is_customer", F.lit(0)) == 1)).alias("is_collection"),
        (F.col("line_out") & (F.coalesce("is_supplier", F.lit(0)) == 1)).alias("is_payment"),
        (F.col("line_drawn") & (F.coalesce("named_supplier", F.lit(0)) != 1)).alias("is_drawing"))


def cash_flow_amounts(gl_entry, account, customer, supplier, party_account, start, end, **options) -> DataFrame:
    """D23 (exact): (Cash_Flow_Category, account_name, amount DECIMAL) for
    collections by bank account, payments out by salary/supplier category
    and other drawings by counterparty.  One ledger pass; ``options`` are
    those of ``classified_cash``."""
    c = classified_cash(gl_entry, account, customer, supplier, party_account, start, end, **options).where(
        F.col("is_collection") | F.col("is_payment") | F.col("is_drawing"))
    n_sal = F.coalesce(F.col("n_salary"), F.lit(0))
    n_oth = F.coalesce(F.col("n_other"), F.lit(0))
    n_sup = n_oth + F.when(n_sal + n_oth == 0, F.lit(1)).otherwise(F.lit(0))

    def entry(cond, cat, name, amount):
        return F.when(cond, F.struct(F.lit(cat).alias("c"), name.cast("string").alias("n"),
                                     amount.cast(_DEC).alias("a")))

    entries = F.array(
        entry(F.col("is_collection"), CAT_COLLECTIONS, F.col("account"), F.col("debit")),
        entry(F.col("is_payment") & (n_sal > 0), CAT_OUTFLOW, F.lit("Salary Payment"), F.col("credit") * n_sal),
        entry(F.col("is_payment") & (n_sup > 0), CAT_OUTFLOW, F.lit("Supplier Payment"), F.col("credit") * n_sup),
        entry(F.col("is_drawing"), CAT_DRAWINGS, F.col("against"), F.col("credit")))
    e = c.select(F.explode(F.filter(entries, lambda x: x.isNotNull())).alias("e"))
    return (e.groupBy(F.col("e.c").alias("Cash_Flow_Category"), F.col("e.n").alias("account_name"))
            .agg(F.sum("e.a").alias("amount")))


def cash_flow(gl_entry, account, customer, supplier, party_account, start, end, **options) -> DataFrame:
    """The flow-diagram edge table."""
    return cash_flow_amounts(gl_entry, account, customer, supplier, party_account, start, end, **options).select(
        "Cash_Flow_Category", "account_name", as_double("amount").alias("amount"))


def cash_flow_totals(gl_entry, account, customer, supplier, party_account, start, end, **options) -> DataFrame:
    """One labelled row with the three category totals (no row when
    the period has no cash flow at all)."""
    flows = cash_flow_amounts(gl_entry, account, customer, supplier, party_account, start, end, **options)

    def cat_sum(cat):
        return as_double(F.sum(F.when(F.col("Cash_Flow_Category") == cat, F.col("amount")).otherwise(_zero())))

    return group_by_constant(flows, "Totals", "Balance/Deficit",
                             cat_sum(CAT_COLLECTIONS).alias("collections"),
                             cat_sum(CAT_OUTFLOW).alias("Supplier_payments"),
                             cat_sum(CAT_DRAWINGS).alias("other_drawings"))


def cash_side(gl_entry, account, start, end, side: str, subtypes, skip_accounts=SKIPPED_BANK_ACCOUNTS) -> DataFrame:
    """The period's bank and cash lines with an amount on ``side``
    (``debit``: money in, ``credit``: money out) and one of the subtypes."""
    if side not in ("debit", "credit"):
        raise ValueError(f"side is debit or credit, not {side!r}")
    return cash_lines(gl_entry, account, start, end, skip_accounts).where(
        (F.col(side) > 0) & F.col("voucher_subtype").isin(*subtypes))


def cash_received(gl_entry, account, customer, start, end, subtypes=COLLECTION_SUBTYPES) -> DataFrame:
    """Money in from customers per bank/cash account.  Lines are summed
    by (against, account) before the customer test."""
    cust = customer.select(F.col("name").alias("against"))
    rows = (cash_side(gl_entry, account, start, end, "debit", subtypes)
            .groupBy("against", "account").agg(money_sum("debit").alias("debit"))
            .join(cust, "against", "left_semi"))
    return rows.groupBy(F.col("account").alias("account_name")).agg(as_double(F.sum("debit")).alias("money_in"))


def cash_paid(gl_entry, account, supplier, start, end, subtypes=PAYMENT_SUBTYPES) -> DataFrame:
    """Payment lines to suppliers from bank/cash accounts."""
    sp = supplier.select(F.col("name").alias("against"), "supplier_name")
    rows = cash_side(gl_entry, account, start, end, "credit", subtypes).join(sp, "against", "inner")
    return rows.select("posting_date", "account", "debit", "credit", "against", "party_type", "supplier_name",
                       "parent_account", "voucher_type", "voucher_no", "voucher_subtype",
                       "against_voucher_type", "against_voucher")


def other_drawings(gl_entry, account, supplier, start, end, transfer_subtypes=TRANSFER_SUBTYPES,
                   own_banks=OWN_BANK_COUNTERPARTIES) -> DataFrame:
    """Cash out that is not an internal transfer, to a counterparty
    that is not a (named) supplier nor the own bank, per counterparty.  The
    lines are summed per counterparty before the supplier test."""
    named = supplier.where(F.col("supplier_name").isNotNull()).select(F.col("name").alias("against"))
    return (cash_lines(gl_entry, account, start, end)
            .where((F.col("credit") > 0) & ~F.col("voucher_subtype").isin(*transfer_subtypes)
                   & ~F.col("against").isin(*own_banks))
            .groupBy("against").agg(as_double(money_sum("credit")).alias("draw_amount"))
            .join(named, "against", "left_anti"))


# --------------------------------------------------------------------------
# Income, expenses and net profit
# --------------------------------------------------------------------------

def _pnl_rows(gl_entry, account, start, end) -> DataFrame:
    acc = accounts_of_type(account, "Income", "Expense", column="root_type").select(
        F.col("name").alias("account"), "parent_account", "root_type")
    rows = not_cancelled(gl_entry).where(date_in_period("posting_date", start, end)).join(acc, "account", "inner")
    exp = F.when(F.col("root_type") == "Expense", money("debit") - money("credit"))
    inc = F.when(F.col("root_type") == "Income", money("credit") - money("debit"))
    return rows.select("parent_account", exp.alias("expense"), inc.alias("income"))


def income_expense(gl_entry, account, start, end) -> DataFrame:
    """Expenses (debit - credit) and income (credit - debit) per parent
    account; NULL where the parent has no row of that kind."""
    return (_pnl_rows(gl_entry, account, start, end).groupBy("parent_account")
            .agg(as_double(F.sum("expense")).alias("total_expenses"), as_double(F.sum("income")).alias("total_income")))


def net_profit(gl_entry, account, start, end, company: str) -> DataFrame:
    """Total income - total expenses of the period in one row (NULL
    when the period has no income or no expense row).  The per-parent step
    of the source is a sum of sums, so it is folded into one aggregate."""
    rows = _pnl_rows(gl_entry, account, start, end)
    return rows.agg(
        F.when(F.count(F.lit(1)) > 0, F.lit(company)).alias("company"),
        F.lit("Net Profit").alias("Account"),
        as_double(F.sum("income") - F.sum("expense")).alias("Net_Profit"),
        F.lit("").alias("Account_type"))
