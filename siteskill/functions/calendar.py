"""Calendar expressions on dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def week_start(d: str | Column) -> Column:
    """The Sunday on or before the date."""
    d = F.col(d) if isinstance(d, str) else d
    return F.date_sub(d, F.dayofweek(d) - 1)


def month_start(d: str | Column) -> Column:
    return F.trunc(d, "MM")


def year_start(d: str | Column) -> Column:
    return F.trunc(d, "YEAR")


def is_leap_day(d: str | Column) -> Column:
    """February 29."""
    return (F.month(d) == 2) & (F.dayofmonth(d) == 29)


def is_day_366(d: str | Column) -> Column:
    """The last day of a leap year: another rule than `is_leap_day`; both are in use."""
    return F.dayofyear(d) == 366


def first_day(year: str | Column) -> Column:
    return F.make_date(F.col(year) if isinstance(year, str) else year, F.lit(1), F.lit(1))


def last_day_of_year(year: str | Column) -> Column:
    return F.make_date(F.col(year) if isinstance(year, str) else year, F.lit(12), F.lit(31))
