"""ERP business rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlake.functions.money import safe_divide


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_base_currency(amount, currency, rate, foreign: str = "USD") -> Column:
    """``amount * rate`` when the document is in the foreign currency."""
    return F.when(_col(currency) == F.lit(foreign), _col(amount) * _col(rate)).otherwise(_col(amount))


def first_non_blank(*cols) -> Column:
    """First argument that is neither NULL nor '' (else NULL)."""
    return F.coalesce(*[F.when(_col(c) != F.lit(""), _col(c)) for c in cols])


def tax_per_unit(taxes, qty) -> Column:
    """Invoice tax spread evenly over its units: 0 when the invoice has no
    tax (or NULL tax), NULL when it has tax but no quantity."""
    return F.when(_col(taxes) != F.lit(0), safe_divide(taxes, qty)).otherwise(F.lit(0).cast("double"))


# Fixed values of the sales-order rules (they must equal the source reports).
ITEM_TAX_TEMPLATE = "Kenya Tax - NML"
ITEM_TAX_FACTOR = 1.16


def add_item_tax(rate, template, tax_name: str = ITEM_TAX_TEMPLATE, factor: float = ITEM_TAX_FACTOR) -> Column:
    """Gross rate for lines carrying the named tax template, rounded to cents."""
    return F.when(_col(template) == F.lit(tax_name), F.round(_col(rate) * F.lit(factor), 2)).otherwise(_col(rate))


# Truckload caps, first matching rule wins.
# (comparison, bags, weight per bag or None = any, currency or None = any, cap)
TRUCKLOAD_RULES = (
    (">=", 680, 0.025, "KES", 680),
    (">=", 680, 0.025, "USD", 680),
    ("=", 480, 0.025, None, 480),
    (">=", 340, None, "KES", 340),
    (">=", 560, None, "USD", 560),
)


def cap_to_truckload(qty, weight, currency, rules=TRUCKLOAD_RULES) -> Column:
    """Bags that fit the truck: the first rule whose test holds gives the
    cap, otherwise the remaining quantity itself."""
    qty, weight, currency = _col(qty), _col(weight), _col(currency)
    expr = None
    for op, bags, per_bag, cur, cap in rules:
        test = (qty >= F.lit(bags)) if op == ">=" else (qty == F.lit(bags))
        if per_bag is not None:
            test = test & (weight == F.lit(per_bag))
        if cur is not None:
            test = test & (currency == F.lit(cur))
        expr = F.when(test, F.lit(cap)) if expr is None else expr.when(test, F.lit(cap))
    return expr.otherwise(qty).cast("double")


def line_tonnes(weight, bags) -> Column:
    """Tonnes of a line, weight per bag times bags."""
    return _col(weight) * _col(bags)


def line_value(bags, rate) -> Column:
    """Value of a line, bags times the base-currency rate."""
    return _col(bags) * _col(rate)


# Payroll classification of supplier payments.
PAYROLL_PARENT = "2500 - Payroll Liabilities - NML"
PAYROLL_PATTERN = "%Payroll%"


def pay_category(parent_account, payroll_parent: str = PAYROLL_PARENT) -> Column:
    """'Salary Payment' for the exact payroll parent, 'Supplier Payment' for
    anything else, NULL included."""
    return F.when(_col(parent_account) == F.lit(payroll_parent), F.lit("Salary Payment")).otherwise(
        F.lit("Supplier Payment"))


def safe_table_name(table_name: str) -> str:
    """'tabSales Invoice' -> 'tabsales_invoice' (output folder name)."""
    return table_name.replace(" ", "_").lower()
