"""Calendar helpers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A Monday before every date Spark can hold, so day counts below stay positive.
_MONDAY = "0001-01-01"


def is_saturday(d: Column) -> Column:
    return F.dayofweek(d) == 7


def is_sunday(d: Column) -> Column:
    return F.dayofweek(d) == 1


def weekend_key(d: Column) -> Column:
    """The Friday before a weekend day; null on weekdays."""
    return F.when(is_saturday(d), F.date_sub(d, 1)).when(is_sunday(d), F.date_sub(d, 2))


def other_weekend_day(d: Column) -> Column:
    """Sunday for a Saturday, Saturday for a Sunday; null on weekdays."""
    return F.when(is_saturday(d), F.date_add(d, 1)).when(is_sunday(d), F.date_sub(d, 1))


def before(a: Column, b: Column) -> Column:
    return a < b


def before_or_equal(a: Column, b: Column) -> Column:
    return a <= b


def after(a: Column, b: Column) -> Column:
    return a > b


def after_or_equal(a: Column, b: Column) -> Column:
    return a >= b


def earlier(a: Column, b: Column) -> Column:
    return F.least(a, b)


def later(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def parse_german(text: Column) -> Column:
    return F.try_to_date(text, "dd.MM.yyyy")


def parse_iso(text: Column) -> Column:
    return F.try_to_date(text, "yyyy-MM-dd")


def parse_basic_iso(text: Column) -> Column:
    """``yyyyMMdd``; empty or null text gives null."""
    return F.when(F.length(text) > 0, F.try_to_date(text, "yyyyMMdd"))


def parse_short_german(text: Column) -> Column:
    """``dd.MM.yy`` in the years 2000 to 2099."""
    long_form = F.concat(F.substring(text, 1, 6), F.lit("20"), F.substring(text, 7, 2))
    return parse_german(long_form)


def format_german(d: Column) -> Column:
    return F.date_format(d, "dd.MM.yyyy")


def format_basic_iso(d: Column) -> Column:
    return F.date_format(d, "yyyyMMdd")


def format_month(d: Column) -> Column:
    return F.date_format(d, "yyyyMM")


def int_day(d: Column) -> Column:
    return F.year(d) * 10000 + F.month(d) * 100 + F.dayofmonth(d)


def int_month(d: Column) -> Column:
    return F.year(d) * 100 + F.month(d)


def add_days(d: Column, n: Column | int) -> Column:
    return F.date_add(d, n)


def add_months(d: Column, n: Column | int) -> Column:
    return F.add_months(d, n)


def first_of_month(d: Column) -> Column:
    return F.trunc(d, "MM")


def middle_of_month(d: Column) -> Column:
    return F.date_add(F.trunc(d, "MM"), 14)


def last_of_month(d: Column) -> Column:
    return F.last_day(d)


def first_of_year(d: Column) -> Column:
    return F.trunc(d, "YEAR")


def first_of_week(d: Column) -> Column:
    return F.trunc(d, "WEEK")


def weekday_of_week(d: Column, iso_weekday: Column | int) -> Column:
    """The given weekday (Monday 1 to Sunday 7) of the Monday-based week of ``d``."""
    offset = iso_weekday - 1
    return F.date_add(first_of_week(d), offset)


def month_length(d: Column) -> Column:
    return F.dayofmonth(F.last_day(d))


def days_between(a: Column, b: Column) -> Column:
    return F.datediff(b, a)


def month_changes(a: Column, b: Column) -> Column:
    return (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)


def _weekdays_through(d: Column) -> Column:
    """Number of Monday-to-Friday days from the fixed Monday through ``d``."""
    n = F.datediff(d, F.lit(_MONDAY).cast("date")) + 1
    return F.floor(n / 7).cast("int") * 5 + F.least(n % 7, F.lit(5))


def weekday_count(a: Column, b: Column) -> Column:
    """Weekdays from ``a`` to ``b`` inclusive; -999 if one is null or the order is reversed."""
    count = _weekdays_through(b) - _weekdays_through(F.date_sub(a, 1))
    return F.when(a.isNull() | b.isNull() | (a > b), -999).otherwise(count).cast("int")


def add_workdays(d: Column, n: Column) -> Column:
    """Move ``n`` work days (signed), skipping weekends; zero keeps the date as it is."""
    weekday = F.weekday(d)
    # A weekend start acts like the Friday before it going forward and like the
    # Monday after it going backward.
    anchor = F.when(weekday < 5, d).when(n > 0, F.date_sub(d, weekday - 4)).otherwise(F.date_add(d, 7 - weekday))
    position = F.when(weekday < 5, weekday).when(n > 0, 4).otherwise(0)
    steps = position + n
    shift = F.floor(steps / 5).cast("int") * 7 + F.pmod(steps, F.lit(5)) - position
    return F.when(n == 0, d).otherwise(F.date_add(anchor, shift))


def today() -> Column:
    return F.current_date()


def first_of_current_month() -> Column:
    return F.trunc(F.current_date(), "MM")
