"""Date and clock expressions."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gazewatch import fixed


def in_lookback(day: Column, target: Column | date, days: int | None = None) -> Column:
    """Day lies in the window of ``days`` days before the target; both days count whole."""
    days = fixed.LOOKBACK_DAYS if days is None else days
    target = _as_date(target)
    return (day >= F.date_sub(target, days)) & (day < F.date_add(target, 1))


def on_day(day: Column, target: Column | date) -> Column:
    return day == _as_date(target)


def is_recent(moment: Column, as_of: Column | date, days: int = fixed.HISTORY_DAYS) -> Column:
    """Not older than ``days`` days before a given day."""
    return moment >= F.date_sub(_as_date(as_of), days)


def days_between(start: Column, end: Column) -> Column:
    """Array of days, both ends included, empty if the range is reversed."""
    day_array = F.sequence(start, F.greatest(start, end), F.expr("interval 1 day"))
    return F.when(start <= end, day_array).otherwise(F.array().cast("array<date>"))


def day_spine(spark: SparkSession, start: date, end: date) -> DataFrame:
    """One row per day, ascending."""
    return spark.range(1).select(
        F.explode(days_between(F.lit(start), F.lit(end))).alias("day")
    )


def is_heartbeat(moment: Column, hours: tuple[int, int] = fixed.HEARTBEAT_HOURS) -> Column:
    """Monday to Friday within the given hours of a time in UTC."""
    first, last = hours
    hour = F.hour(moment)
    return (F.weekday(moment) < 5) & (hour >= first) & (hour < last)


def _as_date(day: Column | date) -> Column:
    return F.lit(day) if isinstance(day, date) else day
