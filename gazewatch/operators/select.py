"""Which edition files a run has to look at. Works on file metadata only."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazewatch.functions import dates as D
from gazewatch.functions import sizing


def file_kind(name: Column) -> Column:
    """``zip``, ``pdf`` or null, by the suffix as written."""
    return F.when(F.endswith(name, F.lit(".zip")), "zip").when(
        F.endswith(name, F.lit(".pdf")), "pdf"
    )


def with_kind(files: DataFrame) -> DataFrame:
    """Add the kind and drop files of any other kind."""
    return files.withColumn("kind", file_kind(F.col("file_name"))).where("kind IS NOT NULL")


def of_section(files: DataFrame, secao: str) -> DataFrame:
    return files.where(F.col("secao") == secao)


def in_window(files: DataFrame, target: date, lookback: int | None) -> DataFrame:
    """Files of the target day and, if a lookback is given, of the days before it."""
    day = F.col("edition_date")
    if lookback is None:
        return files.where(D.on_day(day, target))
    return files.where(D.in_lookback(day, target, lookback))


def prefer_archives(files: DataFrame, earlier: DataFrame | None = None) -> DataFrame:
    """Per day and section: archives if there are any, signed PDFs otherwise.

    ``earlier`` are further files that are no longer listed but count as present,
    as when only the newly arrived ones are at hand. The days that have an archive
    are found by a pre-aggregated distinct, so a day with very many files is never
    gathered in one task.
    """
    files = with_kind(files)
    columns = ["edition_date", "secao", "kind"]
    present = files.select(*columns)
    if earlier is not None:
        present = present.union(with_kind(earlier).select(*columns))
    with_archive = (
        present.where("kind = 'zip'")
        .select("edition_date", "secao")
        .distinct()
        .withColumn("has_archive", F.lit(True))
    )
    return (
        files.join(with_archive, ["edition_date", "secao"], "left")
        .where("kind = 'zip' OR has_archive IS NULL")
        .drop("has_archive")
    )


def new_files(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """Files the ledger does not know. The planner sizes the join from the ledger's statistics."""
    return files.join(ledger.select("file_name"), "file_name", "left_anti")


def committed(matches: DataFrame, ledger: DataFrame) -> DataFrame:
    """Matches whose file the ledger has from the same run; those of unfinished runs are left out."""
    done = ledger.select(F.col("file_name").alias("source_file"), "run_id").distinct()
    return matches.join(done, ["source_file", "run_id"], "left_semi").select(*matches.columns)


def processed_files(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """Files the ledger knows already."""
    return files.join(ledger.select("file_name"), "file_name", "left_semi")


def first_listing(files: DataFrame) -> DataFrame:
    """A file listed on several days belongs to the first of them."""
    others = [c for c in files.columns if c not in ("file_name", "edition_date")]
    return files.groupBy("file_name").agg(
        F.min("edition_date").alias("edition_date"),
        *[F.min_by(c, "edition_date").alias(c) for c in others],
    ).select(*files.columns)


def rules_for_files(files: DataFrame, rules: DataFrame) -> DataFrame:
    """Every file with every rule of its section."""
    return sizing.join_rules(files, rules, F.lit(True), "inner")


def claims(files: DataFrame, rules: DataFrame, mode: str = "all_filters") -> DataFrame:
    """Which rules get to see which file: ``(file_name, filter_ord)``.

    ``all_filters`` gives a file to every rule of its section; ``first_filter``
    gives it to the first one only, which starves the later rules.
    """
    if mode == "all_filters":
        names = files.select("file_name", "secao").distinct()
        return rules_for_files(names, rules.select("filter_ord", "secao")).select("file_name", "filter_ord")
    if mode == "first_filter":
        firsts = rules.groupBy("secao").agg(F.min("filter_ord").alias("filter_ord"))
        claimed = files.select("file_name", "secao").join(firsts, "secao")
        return claimed.groupBy("file_name").agg(F.min("filter_ord").alias("filter_ord"))
    raise ValueError(f"unknown claim mode {mode!r}")


def of_rule_sections(files: DataFrame, rules: DataFrame) -> DataFrame:
    """Files of a section that some rule watches."""
    return sizing.join_rules(files, rules.select("secao").distinct(), F.lit(True), "left_semi")


def ledger_additions(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """Rows to add for processed files: the first per name, unless the name is known."""
    firsts = files.groupBy("file_name").agg(F.min("edition_date").alias("processed_date"))
    return new_files(firsts, ledger)
