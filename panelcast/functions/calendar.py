"""Business-day arithmetic as column expressions (Monday to Friday, no holidays)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def is_business_day(day: Column) -> Column:
    return F.weekday(day) < 5


def last_business_day_on_or_before(day: Column) -> Column:
    return F.date_sub(day, F.greatest(F.weekday(day) - 4, F.lit(0)))


def first_business_day_on_or_after(day: Column) -> Column:
    weekday = F.weekday(day)
    return F.when(weekday >= 5, F.date_add(day, 7 - weekday)).otherwise(day)


def add_business_days(day: Column, n: Column | int) -> Column:
    """``n`` > 0 business days later; from a weekend the count starts at the Friday before."""
    n = F.lit(n) if isinstance(n, int) else n
    anchor = last_business_day_on_or_before(day)
    weeks = F.floor((F.weekday(anchor) + n) / 5).cast("int")
    return F.date_add(anchor, (n + 2 * weeks).cast("int"))


def subtract_business_days(day: Column, n: Column | int) -> Column:
    """``n`` > 0 business days earlier; from a weekend the count starts at the Monday after."""
    n = F.lit(n) if isinstance(n, int) else n
    anchor = first_business_day_on_or_after(day)
    weeks = F.floor((4 - F.weekday(anchor) + n) / 5).cast("int")
    return F.date_sub(anchor, (n + 2 * weeks).cast("int"))


def week_of_month(day: Column) -> Column:
    """1 for days 1-7, 2 for days 8-14, and so on."""
    return (F.floor((F.dayofmonth(day) - 1) / 7) + 1).cast("int")


def parse_compact_date(text: Column) -> Column:
    """``2021-10-29`` or ``20211029`` to a date."""
    return F.to_date(F.regexp_replace(text, "-", ""), "yyyyMMdd")


def format_compact_date(day: Column) -> Column:
    return F.date_format(day, "yyyyMMdd")


def explode_business_days(ranges: DataFrame, start: str, end: str, name: str = "date") -> DataFrame:
    """One row per business day in ``[start, end]``, both ends included."""
    kept = [c for c in ranges.columns if c not in (start, end)]
    valid = ranges.where(F.col(start) <= F.col(end))
    days = F.explode(F.sequence(F.col(start), F.col(end), F.expr("interval 1 day")))
    return valid.select(*kept, days.alias(name)).where(is_business_day(F.col(name)))
