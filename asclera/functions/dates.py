"""Date arithmetic that counts calendar boundaries, and date parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNIT_SECONDS = {"second": 1, "minute": 60, "hour": 3600}


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _seconds(ts: Column) -> Column:
    """Whole seconds since 1970 of a timestamp without time zone."""
    days = F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint")
    return days * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.floor(F.second(ts))


def boundary_diff(unit: str, start: Column | str, end: Column | str) -> Column:
    """Number of ``unit`` boundaries crossed between two dates or timestamps.

    2000-12-31 to 2024-01-01 is 24 years here although 23 have elapsed.
    """
    a, b = _col(start), _col(end)
    if unit == "year":
        return F.year(b) - F.year(a)
    if unit == "month":
        return (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)
    if unit == "day":
        return F.datediff(b.cast("date"), a.cast("date"))
    if unit in UNIT_SECONDS:
        size = UNIT_SECONDS[unit]
        return F.floor(_seconds(b) / size) - F.floor(_seconds(a) / size)
    raise ValueError(f"unknown unit {unit}")


def age(birth: Column | str, as_of: Column | str) -> Column:
    """Age in calendar years at ``as_of``."""
    return boundary_diff("year", birth, as_of)


def day_of_week(value: Column | str) -> Column:
    """0 = Sunday ... 6 = Saturday."""
    return F.dayofweek(_col(value)) - 1


def is_weekend(value: Column | str) -> Column:
    return F.when(day_of_week(value).isin(0, 6), 1).otherwise(0)


def date_parts(column: str, with_hour: bool = False) -> dict[str, Column]:
    """Calendar features of a date column, by feature name."""
    c = F.col(column)
    parts = {
        f"{column}_YEAR": F.year(c),
        f"{column}_MONTH": F.month(c),
        f"{column}_DAY": F.dayofmonth(c),
        f"{column}_DAYOFWEEK": day_of_week(c),
        f"{column}_QUARTER": F.quarter(c),
        f"{column}_IS_WEEKEND": is_weekend(c),
    }
    if with_hour:
        parts[f"{column}_HOUR"] = F.hour(c)
    return parts


def clipped_months(start: Column, end: Column, period_start: Column, period_end: Column) -> Column:
    """Calendar months of [start, end] inside the period, both ends counted, never below 0."""
    months = boundary_diff("month", F.greatest(start, period_start), F.least(end, period_end)) + 1
    return F.greatest(months, F.lit(0))


def compact_date(text: Column | str) -> Column:
    """``yyyyMMdd`` text to a date, NULL when it is not one."""
    return F.try_to_date(_col(text), "yyyyMMdd")


def first_of_year(value: Column | str) -> Column:
    return F.make_date(F.year(_col(value)), F.lit(1), F.lit(1))


def as_date(value) -> Column:
    """A literal date from ``YYYY-MM-DD`` text, a date, or a Column."""
    return value if isinstance(value, Column) else F.lit(str(value)).cast("date")
