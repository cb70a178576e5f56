"""Money arithmetic that gives the same bits in every engine.

Amounts are doubles at rest with at most four decimals.  A double sum depends
on the order rows arrive in, which differs between runs and engines, so sums
are taken over ``DECIMAL(18,4)`` (exact, order free) and turned back into a
double once, at the end.  Division by zero is NULL, as in the source database.

``exact_sum`` is for amounts of up to nine decimals (what the source database
stores) and for their products, of up to eighteen: values are split into limbs
of nine digits, each limb is summed apart as whole numbers, and the limbs meet
once, after the sum.  Nothing is rounded before that, and sums reach 10^27.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

MONEY = DecimalType(18, 4)
# An amount as the source database stores it, and the sum of such amounts.
AMOUNT = DecimalType(30, 9)
EXACT = DecimalType(37, 9)
LIMB = Decimal(10 ** 9)
_WHOLE = DecimalType(38, 0)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def money(c) -> Column:
    """An amount as an exact four-decimal value."""
    return _col(c).cast(MONEY)


def money_sum(c) -> Column:
    """Exact sum of an amount (DECIMAL result; NULL over no rows)."""
    return F.sum(money(c))


def _limbs(c) -> tuple[Column, Column]:
    """An amount's whole part and its nine decimals as a whole number, both towards zero."""
    amount = _col(c).cast(AMOUNT)
    whole = F.when(amount < 0, F.ceil(amount)).otherwise(F.floor(amount))
    rest = (amount - whole).cast(DecimalType(10, 9))
    return whole.cast(DecimalType(21, 0)), (rest * F.lit(LIMB)).cast(DecimalType(9, 0))


def _carry(units: Column) -> tuple[Column, Column]:
    """Whole number of limbs in ``units`` and what is left; both have the sign of ``units``."""
    rest = units % F.lit(LIMB)
    return ((units - rest).cast(_WHOLE) / F.lit(LIMB)).cast(_WHOLE), rest


def _recombine(whole: Column, units: Column) -> Column:
    carried, rest = _carry(units)
    low = rest.cast(DecimalType(10, 0)) * F.lit(Decimal("0.000000001"))
    return ((whole + carried).cast(DecimalType(28, 0)).cast(EXACT) + low).cast(EXACT)


def exact_sum(amount, factor=None) -> Column:
    """SUM(amount), or SUM(amount * factor), over amounts of up to nine decimals: an aggregate of type
    DECIMAL(37,9), rounded half away from zero at the ninth decimal once, after the sum (NULL over no rows).

    A double counts as the decimal number it is written as.  A row where ``amount`` or ``factor`` is NULL is
    skipped, as in SQL."""
    whole, low = _limbs(amount)
    if factor is None:
        return _recombine(F.sum(whole), F.sum(low))
    # (a + b/L) * (c + d/L) = ac + (ad + bc)/L + bd/L^2
    other, other_low = _limbs(factor)
    top = F.sum((whole * other).cast(_WHOLE))
    middle = F.sum((whole * other_low).cast(_WHOLE) + (low * other).cast(_WHOLE))
    carried, rest = _carry(F.sum((low * other_low).cast(_WHOLE)))
    up = F.when(F.abs(rest) * 2 >= F.lit(LIMB), F.signum(rest).cast("int")).otherwise(F.lit(0))
    return _recombine(top, (middle + carried + up).cast(_WHOLE))


def money_round(c, scale: int = 2) -> Column:
    """ROUND half away from zero, on the exact value."""
    return F.round(_col(c), scale)


def as_double(c) -> Column:
    return _col(c).cast("double")


def safe_divide(a, b) -> Column:
    """``a / b`` with NULL for a zero divisor (ANSI mode would raise)."""
    return F.try_divide(_col(a), _col(b))
