"""A run over new editions and a backfill over a range of days."""

from __future__ import annotations

from collections.abc import Collection
from dataclasses import dataclass
from datetime import date, datetime, timezone
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazewatch import fixed, schemas
from gazewatch.functions import dates as D
from gazewatch.functions.sizing import stage, staging
from gazewatch.operators import digest as G
from gazewatch.operators import report, select
from gazewatch.plans.search import find_acts, with_texts
from gazewatch.sinks.tables import Tables, with_ids
from gazewatch.sources.archives import archive_entries, entry_pages
from gazewatch.sources.pages import page_lines


@dataclass(frozen=True)
class Settings:
    """What a run can vary."""

    lookback: int | None = fixed.LOOKBACK_DAYS
    claim: str = "all_filters"
    back: int = fixed.LINES_BACK
    forward: int = fixed.LINES_FORWARD
    prefix: str = "[DOU]"
    heartbeat_hours: tuple[int, int] = fixed.HEARTBEAT_HOURS
    send_digest: bool = True
    #: Acts end where their archive member or page ends.
    entry_scoped: bool = False


@dataclass(frozen=True)
class Outcome:
    run_id: str
    files: int
    matches: int


def run(
    spark: SparkSession,
    files: DataFrame,
    tables: Tables,
    rules: DataFrame,
    target: date,
    run_id: str | None = None,
    page_text: DataFrame | None = None,
    moment: datetime | None = None,
    settings: Settings = Settings(),
) -> Outcome:
    """Search the new editions of the target day and of the days before it.

    ``run_id`` names the attempt: repeating a run under its name replaces what it
    wrote, a new name looks for editions that arrived since.
    """
    moment = moment or datetime.now(timezone.utc)
    run_id = run_id or f"{target.isoformat()}-{moment:%Y%m%dT%H%M%S}"
    window = select.in_window(files, target, settings.lookback)
    chosen = select.prefer_archives(window)
    outcome = process(spark, chosen, tables, rules, run_id, page_text, settings)
    finish(spark, tables, rules, outcome, target, moment, settings)
    return outcome


def backfill(
    spark: SparkSession,
    files: DataFrame,
    tables: Tables,
    rules: DataFrame,
    start: date,
    end: date,
    run_id: str | None = None,
    page_text: DataFrame | None = None,
    settings: Settings = Settings(),
) -> Outcome:
    """Search a whole range of days at once: no lookback, no digest, one run row per day.

    Files in the ledger are passed over, unless ``run_id`` names an earlier backfill,
    which is then repeated.
    """
    run_id = run_id or f"backfill-{start.isoformat()}-{end.isoformat()}-{datetime.now(timezone.utc):%Y%m%dT%H%M%S%f}"
    day = F.col("edition_date")
    chosen = select.prefer_archives(files.where(day.between(F.lit(start), F.lit(end))))
    outcome = process(spark, chosen, tables, rules, run_id, page_text, settings)
    found = tables.of_run("matches", run_id).groupBy("edition_date").agg(
        F.count(F.lit(1)).alias("matches_found")
    )
    done = tables.of_run("processed_files", run_id).groupBy("processed_date").agg(
        F.count(F.lit(1)).alias("files_processed")
    )
    days = D.day_spine(spark, start, end)
    none = F.lit(0).cast("bigint")
    files_processed = F.coalesce("files_processed", none)
    rows = (
        days.join(done, days["day"] == done["processed_date"], "left")
        .join(found, days["day"] == found["edition_date"], "left")
        .select(
            F.col("day").alias("run_date"),
            files_processed.alias("files_processed"),
            F.coalesce("matches_found", none).alias("matches_found"),
            F.lit(0).alias("email_sent"),
            report.run_notes(files_processed, None).alias("notes"),
        )
    )
    tables.put_run(rows, run_id)
    return outcome


def process(
    spark: SparkSession,
    chosen: DataFrame,
    tables: Tables,
    rules: DataFrame,
    run_id: str,
    page_text: DataFrame | None,
    settings: Settings,
    days: Collection[date] | None = None,
) -> Outcome:
    """Read, search and store. Matches are stored before the ledger names their files.

    A failure in between therefore repeats work instead of losing matches, and the
    repetition replaces the partitions of the same run. The anti join comes before
    any content is read, and content is read once into a staged table of lines. ``days``
    are those that the files can be in the ledger for, if that is known.
    """
    tables.begin(run_id)
    # Archives are found under their names in an escaped form that any store takes.
    work = f"{tables.path('_work')}/{quote(run_id, safe='')}"
    with staging(spark, work):
        ledger = tables.known_files(run_id, days)
        fresh = select.new_files(select.of_rule_sections(chosen, rules), ledger)
        new = stage(select.first_listing(fresh.select(*schemas.FILES.names)), "files")

        pages = stage(edition_pages(new, page_text), "pages")
        failed = stage(failures(new, pages), "failed")
        read = new.join(failed.select("file_name"), "file_name", "left_anti")
        good = pages.where("err IS NULL").join(failed.select("file_name"), "file_name", "left_anti")
        lines = stage(page_lines(good.drop("err"), settings.entry_scoped), "lines")

        allowed = None
        if settings.claim != "all_filters":
            allowed = select.claims(read, rules, settings.claim)
        acts = find_acts(lines, rules, back=settings.back, forward=settings.forward, allowed=allowed)
        # Acts are numbered as short rows, and the run's ids set aside, before any text is fetched.
        acts = stage(acts.withColumnRenamed("file_name", "source_file"), "acts")
        numbered = with_ids(acts, tables.reserve("matches", acts.count(), run_id) - 1)
        found = with_texts(numbered.withColumnRenamed("source_file", "file_name"), lines)
        matches = tables.put_matches(found, run_id)
        tables.put_quarantine(failed, run_id)
        return Outcome(run_id, tables.put_processed(read, run_id), matches)


def edition_pages(files: DataFrame, page_text: DataFrame | None) -> DataFrame:
    """Text of editions by page: members of archives, and page text held for signed PDFs."""
    pages = entry_pages(archive_entries(files))
    if page_text is None:
        return pages
    signed = select.with_kind(files).where("kind = 'pdf'").drop("kind", "path", "length")
    held = page_text.select("file_name", "page_no", "text").join(signed, "file_name")
    return pages.unionByName(held.withColumn("err", F.lit(None).cast("string")))


def failures(files: DataFrame, pages: DataFrame) -> DataFrame:
    """Files that could not be read, with the reason; they stay out of the ledger."""
    broken = pages.where("err IS NOT NULL").groupBy("file_name").agg(F.min("err").alias("err"))
    signed = select.with_kind(files).where("kind = 'pdf'")
    without = signed.join(pages.select("file_name").distinct(), "file_name", "left_anti")
    missing = without.select("file_name", F.lit("no page text").alias("err"))
    reasons = broken.unionByName(missing)
    return files.select("file_name", "edition_date").join(reasons, "file_name")


def finish(
    spark: SparkSession,
    tables: Tables,
    rules: DataFrame,
    outcome: Outcome,
    target: date,
    moment: datetime,
    settings: Settings,
) -> None:
    """Digest and run row, from what was stored."""
    # Without a zone, so that the hour is the UTC hour in any session.
    stamp = F.lit(f"{moment.astimezone(timezone.utc):%Y-%m-%d %H:%M:%S}").cast("timestamp_ntz")
    n_matches = F.lit(outcome.matches)
    due = G.is_due(n_matches, stamp, settings.heartbeat_hours) & F.lit(settings.send_digest)
    summary = spark.range(1).select(
        F.lit(target).alias("run_date"),
        F.lit(outcome.files).alias("files_processed"),
        n_matches.alias("matches_found"),
        due.cast("int").alias("email_sent"),
        report.run_notes(F.lit(outcome.files), settings.lookback).alias("notes"),
    )
    if outcome.matches and settings.send_digest:
        stored = tables.of_run("matches", outcome.run_id).withColumn("run_date", F.lit(target))
        sections = G.distinct_sections(rules).first()[0]
        message = G.digest(
            summary.select("run_date", F.col("matches_found").alias("n_matches")), settings.prefix, sections, settings.lookback
        )
        items = G.digest_items(G.numbered(stored))
    else:
        items = None
        message = summary.where("email_sent = 1").select(
            "run_date",
            F.lit(0).alias("n_matches"),
            G.subject(settings.prefix, F.col("run_date"), n_matches).alias("subject"),
            G.heartbeat(settings.prefix, F.col("run_date")).alias("head"),
            F.lit("").alias("foot"),
        )
    tables.put_digest(message, items, outcome.run_id)
    tables.put_run(summary, outcome.run_id)
