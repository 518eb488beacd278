"""Fiscal calendar (April to March) and date text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fiscal_quarter(period: Column) -> Column:
    month = F.month(period)
    return F.when(month == 6, 1).when(month == 9, 2).when(month == 12, 3).when(month == 3, 4)


def fiscal_year(period: Column) -> Column:
    return F.year(period) + F.when(F.month(period) > 3, 1).otherwise(0)


def month_label(day: Column, fallback: Column) -> Column:
    return F.coalesce(F.date_format(day, "MMM yyyy"), fallback)


MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def written_date(text: Column) -> Column:
    """'YYYY-MM-DD' of the first 'Month D, YYYY' in a text; null if its first such triple has no month's name."""
    found = r"(\w+)\s+(\d{1,2}),?\s+(\d{4})"
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(F.regexp_extract(text, found, 1)))
    day, year = F.regexp_extract(text, found, 2), F.regexp_extract(text, found, 3)
    return F.when(month > 0, F.concat_ws("-", year, F.lpad(month.cast("string"), 2, "0"), F.lpad(day, 2, "0")))


def utc_time(text: Column, zone: str = "Asia/Kolkata") -> Column:
    """A local time without its fraction of a second, in UTC; null if it is none."""
    return F.to_utc_timestamp(F.try_to_timestamp(F.regexp_replace(text, r"\.\d+$", "")), zone)


def fiscal_year_end(day: Column) -> Column:
    """The last 31 March on or before a day."""
    return F.make_date(F.year(day) - F.when((F.month(day) < 3) | ((F.month(day) == 3) & (F.dayofmonth(day) < 31)), 1).otherwise(0), F.lit(3), F.lit(31))
