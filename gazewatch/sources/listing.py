"""Edition names: found on listing pages or taken from storage paths."""

from __future__ import annotations

from collections.abc import Collection, Sequence
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gazewatch import fixed
from gazewatch.functions import text as X


def listed_files(
    listing: DataFrame,
    sections: Sequence[str],
    patterns: Sequence[str] = fixed.LISTING_PATTERNS,
) -> DataFrame:
    """Every edition name of the given sections on the listing of a day.

    A name counts for the day it is listed under, whatever date it carries.
    """
    found = F.array(
        *[
            F.struct(
                F.lit(secao).alias("secao"),
                F.concat(
                    *[
                        F.regexp_extract_all(
                            "body",
                            F.lit(f"({X.portable(p.replace('{n}', X.section_number(secao)))})"),
                            F.lit(1),
                        )
                        for p in patterns
                    ]
                ).alias("names"),
            )
            for secao in sections
        ]
    )
    return (
        listing.select("edition_date", F.inline(found))
        .select("edition_date", "secao", F.explode("names").alias("file_name"))
        .distinct()
    )


def distinct_names(pages: DataFrame, column: str, patterns: Sequence[str]) -> DataFrame:
    """The union of what several patterns find in a column, each name once."""
    parts = [
        pages.select(F.explode(F.regexp_extract_all(column, F.lit(p), F.lit(1))).alias("name"))
        for p in patterns
    ]
    return reduce(DataFrame.union, parts).distinct()


def edition_attributes(files: DataFrame) -> DataFrame:
    """Take name, day and section from the path of a stored edition; others are dropped."""
    name = F.element_at(F.split("path", "/"), -1)
    zipped = r"^(\d{4})-(\d{2})-(\d{2})-DO(\d+)E?\.zip$"
    signed = r"^(\d{4})_(\d{2})_(\d{2})_ASSINADO_do(\d+)(?:_extra_[ABC])?\.pdf$"

    def part(i: int) -> Column:
        return F.concat(
            F.regexp_extract("file_name", zipped, i), F.regexp_extract("file_name", signed, i)
        )

    return (
        files.withColumn("file_name", name)
        .where(F.rlike("file_name", F.lit(zipped)) | F.rlike("file_name", F.lit(signed)))
        .select(
            "file_name",
            F.concat(F.lit("DO"), part(4)).alias("secao"),
            F.try_to_date(F.concat_ws("-", part(1), part(2), part(3)), "yyyy-MM-dd").alias(
                "edition_date"
            ),
            *[c for c in files.columns if c != "file_name"],
        )
        .where("edition_date IS NOT NULL")
    )


# Listings of up to so many days are restricted to names that begin with one of them.
GLOB_DAYS = 31


def stored_files(spark: SparkSession, folder: str, days: Collection[date] | None = None) -> DataFrame:
    """Editions in storage, of the given days if any are. Only names and lengths are listed; no content is read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if days is not None and 0 < len(days) <= GLOB_DAYS:
        names = [form for d in days for form in (f"{d:%Y-%m-%d}-*", f"{d:%Y_%m_%d}_*")]
        reader = reader.option("pathGlobFilter", "{" + ",".join(sorted(names)) + "}")
    files = edition_attributes(reader.load(folder).select("path", "length"))
    return files if days is None else files.where(F.col("edition_date").isin(*days) if days else F.lit(False))
