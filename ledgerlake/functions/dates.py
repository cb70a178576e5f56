"""Date helpers.  Periods are written as ranges on the raw column so that
Parquet min/max statistics and ``ds=`` partitions prune the scan; a
``month(d) = month(x)`` predicate would be evaluated row by row."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def _date(x=None) -> Column:
    """A date as a column; None is today."""
    if x is None:
        return F.current_date()
    if isinstance(x, Column):
        return x
    if isinstance(x, (dt.date, dt.datetime)):
        return F.lit(x if isinstance(x, dt.date) and not isinstance(x, dt.datetime) else x.date())
    if isinstance(x, str):
        return F.lit(dt.date.fromisoformat(x))
    raise TypeError(f"not a date: {x!r}")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def week_sunday(d) -> Column:
    """Week of the year, weeks start on Sunday, 0..53; days before the
    year's first Sunday are week 0 (MySQL ``WEEK(d, 0)``, ``%U``)."""
    d = _col(d)
    return ((F.dayofyear(d) + F.lit(7) - F.dayofweek(d)) / F.lit(7)).cast("int")


def month_start(as_of) -> Column:
    return F.trunc(_date(as_of), "MM")


def month_end(as_of) -> Column:
    return F.last_day(_date(as_of))


def days_in_month(as_of) -> Column:
    return F.dayofmonth(F.last_day(_date(as_of)))


def date_in_period(d, start, end) -> Column:
    """Inclusive ``BETWEEN start AND end``."""
    return _col(d).between(_date(start), _date(end))


def last_n_days(d, as_of, n: int, replay: bool = False) -> Column:
    """``d >= as_of - n days``, without an upper bound; ``replay`` adds
    ``d <= as_of``, to rebuild what the live report saw on a past day."""
    cond = _col(d) >= F.date_sub(_date(as_of), n)
    if replay:
        cond = cond & (_col(d) <= _date(as_of))
    return cond


def as_date(x=None) -> Column:
    return _date(x)
