"""Continuous monitoring: new edition files as a stream."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gazewatch import schemas
from gazewatch.operators import select
from gazewatch.plans.runs import Settings, finish, process
from gazewatch.sinks.tables import Tables
from gazewatch.sources.listing import edition_attributes, stored_files


def arriving_files(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """Names of edition files as they arrive; content is not part of the stream.

    The source remembers every file it has seen, so ``maxFileAge`` is lifted far
    beyond any delay: an extra edition that arrives late is still new.
    """
    arrived = (
        spark.readStream.format("binaryFile")
        .schema(schemas.BINARY_FILES)
        .option("recursiveFileLookup", "true")
        .option("maxFileAge", "3650d")
    )
    if files_per_batch:
        arrived = arrived.option("maxFilesPerTrigger", files_per_batch)
    return edition_attributes(arrived.load(folder).select("path", "length"))


def drop_repeats(arrivals: DataFrame, within: str = "2 days") -> DataFrame:
    """Deduplicate names with bounded state: a name is remembered for a while after it arrives.

    Event time is the moment a name is seen, so an edition of long ago that arrives now is not
    late. The ledger covers repeats that come after a name is forgotten.
    """
    return (
        arrivals.withColumn("seen_at", F.current_timestamp())
        .withWatermark("seen_at", within)
        .dropDuplicatesWithinWatermark(["file_name"])
        .drop("seen_at")
    )


def search_batch(
    folder: str,
    tables: Tables,
    rules: DataFrame,
    name: str,
    settings: Settings = Settings(),
    clock: Callable[[], datetime] = lambda: datetime.now(timezone.utc),
    page_text: DataFrame | None = None,
) -> Callable[[DataFrame, int | str], None]:
    """The work on one micro-batch. A repeated batch has the same number and replaces itself.

    Which files count is decided on the names in the folder, not on the batch, so the
    size of batches changes nothing: an archive that is listed, even a broken one, hides
    the signed files of its day and section. Files in quarantine that are still listed
    are tried again with the batch.
    """

    def search(batch: DataFrame, number: int | str) -> None:
        spark = batch.sparkSession
        run_id = f"{name}-{number}"
        moment = clock()
        quarantined = tables.written("quarantine").select("file_name", "edition_date").distinct()
        # Without the ledger of an earlier try of this batch, which is about to be replaced.
        failed = select.new_files(quarantined, tables.known_files(run_id, _days(quarantined)))
        # Folder and ledger are looked at for the days of the batch and of failed files only.
        days = _days(batch.select("edition_date").union(failed.select("edition_date")))
        listed = stored_files(spark, folder, days)
        again = listed.join(failed.select("file_name"), "file_name", "left_semi")
        wanted = batch.unionByName(again).groupBy("file_name").agg(
            *[F.min_by(c, "path").alias(c) for c in schemas.FILES.names if c != "file_name"]
        )
        of_sections = wanted.select("edition_date", "secao").distinct()
        present = listed.join(of_sections, ["edition_date", "secao"], "left_semi")
        chosen = select.prefer_archives(wanted, present)
        outcome = process(spark, chosen, tables, rules, run_id, page_text, settings, days)
        finish(spark, tables, rules, outcome, moment.date(), moment, settings)

    return search


def _days(files: DataFrame) -> list[date]:
    return sorted(r[0] for r in files.select("edition_date").distinct().collect() if r[0])


def monitor(
    spark: SparkSession,
    folder: str,
    tables: Tables,
    rules: DataFrame,
    checkpoint: str,
    name: str = "monitor",
    settings: Settings = Settings(),
    clock: Callable[[], datetime] = lambda: datetime.now(timezone.utc),
    page_text: DataFrame | None = None,
    files_per_batch: int | None = None,
    remember: str = "2 days",
) -> StreamingQuery:
    """Search whatever arrived since the last call, then stop. Meant to be run periodically.

    A name that arrives again within ``remember``, in whatever folder, is dropped by the state
    of the stream; one that arrives later by the ledger. A call that finds nothing new still writes its run row, tries files in quarantine
    again, and sends the heartbeat if it is due.
    """
    work = search_batch(folder, tables, rules, name, settings, clock, page_text)
    batches = []

    def count_and_work(batch: DataFrame, number: int) -> None:
        # A batch of nothing but repeats, or one that only forgets names, is no run.
        if not batch.isEmpty():
            batches.append(number)
            work(batch, number)

    query = (
        drop_repeats(arriving_files(spark, folder, files_per_batch), remember)
        .writeStream.queryName(name)
        .foreachBatch(count_and_work)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    if not batches:
        work(spark.createDataFrame([], schemas.FILES), f"quiet-{datetime.now(timezone.utc):%Y%m%dT%H%M%S%f}")
    return query
