"""Counts over stored matches and processed files."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazewatch import fixed
from gazewatch.functions import dates as D


def matches_per_filter(matches: DataFrame) -> DataFrame:
    """How many matches each rule has, most first."""
    counts = matches.groupBy("filter_name").agg(F.count(F.lit(1)).alias("total"))
    return counts.orderBy(F.desc("total"), "filter_name")


def matches_per_period(matches: DataFrame, units: Sequence[str] = ("day", "week", "month")) -> DataFrame:
    """How many matches each rule has in every period with any: (unit, period, filter_name, total).

    Counted by day once; longer periods add up days.
    """
    daily = matches.groupBy("edition_date", "filter_name").agg(F.count(F.lit(1)).alias("_n"))
    starts = F.array(
        *[F.struct(F.lit(u).alias("unit"), F.to_date(F.date_trunc(u, "edition_date")).alias("period")) for u in units]
    )
    spread = daily.select("filter_name", "_n", F.inline(starts))
    return spread.groupBy("unit", "period", "filter_name").agg(F.sum("_n").alias("total"))


def recent(rows: DataFrame, moment: str, as_of: date, days: int = fixed.HISTORY_DAYS) -> DataFrame:
    """Rows of the last ``days`` days, newest first."""
    return rows.where(D.is_recent(F.col(moment), as_of, days)).orderBy(F.desc(moment))


def run_notes(files: Column, lookback: int | None) -> Column:
    scope = "Sem lookback (backfill)" if lookback is None else f"Lookback: {lookback} dias"
    return F.concat(
        F.lit(scope + ", "), files.cast("string"), F.lit(" arquivo(s) processado(s)")
    )


def run_summary(
    processed: DataFrame, matches: DataFrame, lookback: int | None, sent: Column
) -> DataFrame:
    """One row per run from ``(run_date, file_name)`` and ``(run_date)`` rows.

    Files without matches count as processed. Both sides are reduced before they
    meet, so the join is as short as the list of runs.
    """
    files = processed.groupBy("run_date").agg(
        F.count_distinct("file_name").alias("files_processed")
    )
    found = matches.groupBy("run_date").agg(F.count(F.lit(1)).alias("matches_found"))
    summary = files.join(found, "run_date", "left").withColumn(
        "matches_found", F.coalesce("matches_found", F.lit(0).cast("bigint"))
    )
    return summary.select(
        "run_date",
        "files_processed",
        "matches_found",
        sent.cast("int").alias("email_sent"),
        run_notes(F.col("files_processed"), lookback).alias("notes"),
    )


def per_day(matches: DataFrame, start: date, end: date) -> DataFrame:
    """Matches on every day of a range, days without any included, and the grand total."""
    days = D.day_spine(matches.sparkSession, start, end)
    counts = (
        matches.where(F.col("edition_date").between(F.lit(start), F.lit(end)))
        .groupBy("edition_date")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    daily = days.join(counts, days["day"] == counts["edition_date"], "left")
    return daily.rollup("day").agg(
        F.coalesce(F.sum("n"), F.lit(0).cast("bigint")).alias("matches_found"),
        F.grouping("day").cast("int").alias("is_total"),
    )
