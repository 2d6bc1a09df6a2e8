"""Calendar columns: federal holidays, business days, filing deadlines, calendar bounds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAYS = ("SUN", "MON", "TUE", "WED", "THU", "FRI", "SAT")


def _date(year: Column, month: int, day: int) -> Column:
    return F.make_date(year, F.lit(month), F.lit(day))


def observed(d: Column) -> Column:
    """A fixed holiday's day off: Friday for a Saturday, Monday for a Sunday."""
    return F.when(F.dayofweek(d) == 7, F.date_sub(d, 1)).when(F.dayofweek(d) == 1, F.date_add(d, 1)).otherwise(d)


def nth_weekday(year: Column, month: int, day: str, n: int) -> Column:
    return F.date_add(F.next_day(F.date_sub(_date(year, month, 1), 1), day), 7 * (n - 1))


def last_weekday(year: Column, month: int, day: str) -> Column:
    return F.next_day(F.date_sub(F.last_day(_date(year, month, 1)), 7), day)


def federal_holidays(year: Column) -> Column:
    """The eleven holidays of a year as days off."""
    return F.array(
        observed(_date(year, 1, 1)), nth_weekday(year, 1, "MON", 3), nth_weekday(year, 2, "MON", 3), last_weekday(year, 5, "MON"),
        observed(_date(year, 6, 19)), observed(_date(year, 7, 4)), nth_weekday(year, 9, "MON", 1), nth_weekday(year, 10, "MON", 2),
        observed(_date(year, 11, 11)), nth_weekday(year, 11, "THU", 4), observed(_date(year, 12, 25)))


def is_business_day(d: Column) -> Column:
    return ~F.dayofweek(d).isin(1, 7) & ~F.array_contains(federal_holidays(F.year(d)), d)


def next_business_day(d: Column) -> Column:
    """The first business day on or after d."""
    return F.get(F.filter(F.sequence(d, F.date_add(d, 10)), is_business_day), F.lit(0))


def filing_due(report_period: Column) -> Column:
    return next_business_day(F.date_add(report_period, 45))


def next_filing(report_period: Column) -> Column:
    """45 days past the end of the next quarter."""
    return F.date_add(F.last_day(F.add_months(report_period, 3)), 45)


def month_grid(month_start: Column) -> tuple[Column, Column]:
    """Monday before (or at) a month's first day, Sunday after (or at) its last."""
    first = F.date_trunc("week", month_start).cast("date")
    return first, F.date_add(F.date_trunc("week", F.last_day(month_start)).cast("date"), 6)
