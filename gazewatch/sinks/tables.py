"""The stored tables: matches, ledger, quarantine, runs, digests and their items, as Parquet.

They are tables of the session's catalog over folders, in a database of their own, so that SQL
finds them and a reader opens only the partitions it asks for. Every table has a folder for
each run that wrote it, and a run replaces its whole folders, also where it has nothing to
write. The ledger comes last and makes the rest valid: matches count once their file is in the
ledger under the same run, and a file in the ledger is no longer in quarantine. So a run that
failed half way can be repeated, or followed by another one, and each match is seen once.

Small folders of many runs are put together by day (`compact`); see there.
"""

from __future__ import annotations

import uuid
from collections.abc import Collection
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gazewatch import schemas
from gazewatch.functions import sizing
from gazewatch.operators import select
from gazewatch.operators.acts import WINDOW_TILE
from gazewatch.operators.numbering import ordered_rank
from gazewatch.sinks import ids

#: What is written: table, schema, partitions.
LAYOUT = {
    "matches": (schemas.MATCHES, ("run_id", "edition_date")),
    "matches_by_day": (schemas.DAYS, ("edition_date", "version")),
    "processed_files": (schemas.LEDGER, ("run_id", "file_date")),
    "quarantine": (schemas.QUARANTINE, ("run_id",)),
    "runs": (schemas.RUNS, ("run_id",)),
    "digests": (schemas.DIGESTS, ("run_id",)),
    "digest_items": (schemas.DIGEST_ITEMS, ("run_id",)),
}
#: What is written under one name and read under another, where not every row is valid.
VIEWS = ("matches", "quarantine")


def _quoted(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


@dataclass(frozen=True)
class Tables:
    spark: SparkSession
    root: str
    database: str = "gazette"

    # --- definitions ---------------------------------------------------------------------

    def create(self) -> Tables:
        """Create the database, its tables and views where the catalog lacks them.

        A catalog that is new to existing folders lists them once.
        """
        catalog = self.spark.catalog
        if not catalog.databaseExists(self.database):
            self.spark.sql(f"CREATE DATABASE IF NOT EXISTS {self.database} LOCATION {_quoted(self.path('_catalog'))}")
        for name, (schema, parts) in LAYOUT.items():
            table = self.table(name)
            if not catalog.tableExists(table):
                columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields)
                self.spark.sql(
                    f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet "
                    f"PARTITIONED BY ({', '.join(parts)}) LOCATION {_quoted(self.path(name))}"
                )
                if sizing.folder_names(self.spark, self.path(name)):
                    self.spark.sql(f"ALTER TABLE {table} RECOVER PARTITIONS")
        self._create_views()
        return self

    def _create_views(self) -> None:
        columns = ", ".join(f.name for f in schemas.MATCHES.fields)
        rows, days, ledger = self.table("matches"), self.table("matches_by_day"), self.table("processed_files")
        # The last version of a day holds all of the runs in it; their own folders no longer count.
        self.spark.sql(f"""CREATE OR REPLACE VIEW {self.database}.matches AS
            WITH latest AS (
                SELECT d.* FROM {days} d JOIN (
                    SELECT edition_date, max(version) AS version FROM {days} GROUP BY edition_date) v
                ON d.edition_date = v.edition_date AND d.version = v.version),
            both AS (
                SELECT {columns} FROM latest WHERE run_id IS NOT NULL UNION ALL
                SELECT {columns} FROM {rows} r LEFT ANTI JOIN (SELECT DISTINCT run_id, edition_date FROM latest) l
                ON r.run_id = l.run_id AND r.edition_date = l.edition_date)
            SELECT * FROM both m LEFT SEMI JOIN {ledger} p ON m.source_file = p.file_name AND m.run_id = p.run_id""")
        self.spark.sql(f"""CREATE OR REPLACE VIEW {self.database}.quarantine AS
            SELECT * FROM {self.table('quarantine')} q LEFT ANTI JOIN {ledger} p ON q.file_name = p.file_name""")

    def path(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"

    def table(self, name: str) -> str:
        """The catalog's name of what is written."""
        return f"{self.database}.{name}{'_written' if name in VIEWS else ''}"

    # --- reading -------------------------------------------------------------------------

    def written(self, name: str) -> DataFrame:
        """All rows of a table, those of unfinished runs too."""
        return self.spark.table(self.table(name))

    def read(self, name: str) -> DataFrame:
        """The valid rows of a table."""
        return self.spark.table(f"{self.database}.{name}")

    def of_run(self, name: str, run_id: str) -> DataFrame:
        return self.read(name).where(F.col("run_id") == run_id)

    def known_files(self, run_id: str | None = None, days: Collection[date] | None = None) -> DataFrame:
        """The ledger as a run must see it: without what an earlier try of the same run wrote.

        ``days`` restricts it to files with those days in their names; only their folders are opened.
        """
        ledger = self.written("processed_files")
        if run_id is not None:
            ledger = ledger.where(F.col("run_id") != run_id)
        if days is not None:
            ledger = ledger.where(F.col("file_date").isin(*days) if days else F.lit(False))
        return ledger

    # --- writing -------------------------------------------------------------------------

    def _replace(self, name: str, rows: DataFrame, run_id: str) -> int:
        """Replace all that a run has written, also by nothing, and say how many rows there are now.

        Rows are gathered by partition first, or every task would write a small file
        into every day; the rebalance splits days that are too large for one task. They are
        counted as they are written. The catalog then takes the run's partitions as they are.
        """
        schema, parts = LAYOUT[name]
        columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields if f.name != "run_id"]
        counted = Observation()
        (
            rows.select(*columns)
            .hint("rebalance", *parts[1:])
            .observe(counted, F.count(F.lit(1)).alias("n"))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "static")
            .partitionBy(*parts[1:])
            .parquet(self._run_folder(name, run_id))
        )
        self._partitions_of(name, run_id)
        return counted.get.get("n", 0)

    def _run_folder(self, name: str, run_id: str) -> str:
        escaped = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(run_id)
        return f"{self.path(name)}/run_id={escaped}"

    def _partitions_of(self, name: str, run_id: str) -> None:
        """Let the catalog know which partitions a run has, from the names in the run's folder alone."""
        table, spec = self.table(name), f"run_id = {_quoted(run_id)}"
        inner = LAYOUT[name][1][1:]
        self.spark.sql(f"ALTER TABLE {table} DROP IF EXISTS PARTITION ({spec})")
        if not inner:
            found = [f"PARTITION ({spec})"]
        else:
            names = sizing.folder_names(self.spark, self._run_folder(name, run_id))
            days = sorted(n.partition("=")[2] for n in names if n.startswith(f"{inner[0]}="))
            found = [f"PARTITION ({spec}, {inner[0]} = {_quoted(d)})" for d in days]
        if found:
            self.spark.sql(f"ALTER TABLE {table} ADD IF NOT EXISTS {' '.join(found)}")
        self.spark.sql(f"REFRESH TABLE {table}")

    def begin(self, run_id: str) -> None:
        """Take back what an earlier try of a run had declared done, the ledger first."""
        for name in ("processed_files", "runs", "digests", "digest_items"):
            if sizing.folder_names(self.spark, self._run_folder(name, run_id)):
                self._replace(name, self.spark.createDataFrame([], LAYOUT[name][0]), run_id)
        held = self.written("matches_by_day").where(F.col("run_id") == run_id).select("edition_date").distinct()
        for row in held.collect():
            self.compact(row.edition_date, without=run_id)

    def reserve(self, name: str, n: int, run_id: str) -> int:
        """The first of n row ids that no other run has or will get."""
        return ids.reserve(self.spark, self.path(f"_ids/{name}"), n, run_id)

    def put_matches(self, matches: DataFrame, run_id: str) -> int:
        """Store the matches of a run and say how many there are. They count once the ledger has their files."""
        if "id" not in matches.columns:
            matches = sizing.stage(matches, "unnumbered")
            matches = with_ids(matches, self.reserve("matches", matches.count(), run_id) - 1)
        return self._replace("matches", matches.withColumn("created_ts", F.current_timestamp()), run_id)

    def put_processed(self, files: DataFrame, run_id: str) -> int:
        """Enter files into the ledger unless they are there."""
        rows = select.ledger_additions(files, self.known_files(run_id))
        named = F.try_to_date(F.replace(F.substring("file_name", 1, 10), F.lit("_"), F.lit("-")))
        rows = rows.withColumns(
            {"processed_ts": F.current_timestamp(), "file_date": F.coalesce(named, F.col("processed_date"))}
        )
        return self._replace("processed_files", rows, run_id)

    def put_quarantine(self, failures: DataFrame, run_id: str) -> None:
        self._replace("quarantine", failures, run_id)

    def put_run(self, run: DataFrame, run_id: str) -> None:
        """Store the run rows, one for each day; they are numbered by day."""
        days = run.select("run_date").distinct().count()
        nth = F.row_number().over(Window.orderBy("run_date"))
        numbered = run.withColumn("id", nth + F.lit(self.reserve("runs", days, run_id) - 1))
        self._replace("runs", numbered.withColumn("run_ts", F.current_timestamp()), run_id)

    def put_digest(self, digest: DataFrame, items: DataFrame | None, run_id: str) -> None:
        """Store a message and, if it has any, its items; they come first."""
        if items is not None:
            self._replace("digest_items", items, run_id)
        self._replace("digests", digest, run_id)

    # --- layout --------------------------------------------------------------------------

    def compact(self, day: date, without: str | None = None) -> int:
        """Put the valid matches of a day from finished runs into one folder; returns its version.

        The folder is written aside and moved to its place in one step, as the day's next
        version. From then on it stands for the runs in it, and their folders of that day are
        removed, as is the version before; until then readers pass over them. ``without``
        leaves out a run that is about to be repeated.
        """
        folder = f"matches_by_day/edition_date={day.isoformat()}"
        versions = [int(n.partition("=")[2]) for n in sizing.folder_names(self.spark, self.path(folder)) if "=" in n]
        version = max(versions, default=0) + 1
        finished = self.written("runs").select("run_id").distinct()
        rows = self.read("matches").where(F.col("edition_date") == F.lit(day))
        if without is not None:
            rows = rows.where(F.col("run_id") != without)
        rows = rows.join(finished, "run_id", "left_semi")
        columns = [f.name for f in schemas.DAYS.fields if f.name not in LAYOUT["matches_by_day"][1]]
        # A day that is left without rows has a version all the same, of one row without a run.
        mark = self.spark.range(1).select(*[F.lit(None).cast(schemas.DAYS[c].dataType).alias(c) for c in columns])
        aside = self.path(f"_work/compact-{uuid.uuid4().hex}")
        rows.select(*columns).hint("rebalance").unionByName(mark).write.parquet(aside)
        sizing.move_folder(self.spark, aside, self.path(f"{folder}/version={version}"))
        table = self.table("matches_by_day")
        spec = f"edition_date = {_quoted(day.isoformat())}, version"
        self.spark.sql(f"ALTER TABLE {table} ADD IF NOT EXISTS PARTITION ({spec} = {version})")
        self.spark.sql(f"REFRESH TABLE {table}")
        # What the version stands for: its runs' folders of the day, and earlier versions.
        held = self.spark.read.schema(schemas.DAYS).parquet(self.path(f"{folder}/version={version}"))
        for row in held.select("run_id").distinct().where("run_id IS NOT NULL").collect():
            self._drop("matches", f"run_id = {_quoted(row.run_id)}, edition_date = {_quoted(day.isoformat())}")
            sizing.drop_folder(self.spark, f"{self._run_folder('matches', row.run_id)}/edition_date={day.isoformat()}")
        for earlier in versions:
            self._drop("matches_by_day", f"{spec} = {earlier}")
            sizing.drop_folder(self.spark, self.path(f"{folder}/version={earlier}"))
        return version

    def _drop(self, name: str, spec: str) -> None:
        self.spark.sql(f"ALTER TABLE {self.table(name)} DROP IF EXISTS PARTITION ({spec})")
        self.spark.sql(f"REFRESH TABLE {self.table(name)}")


def with_ids(matches: DataFrame, highest: int = 0) -> DataFrame:
    """Consecutive row ids after the highest one in use, in the order of the digest."""
    keyed = (
        matches.withColumn("_file", F.struct("filter_ord", "source_file"))
        .withColumn("_lines", F.struct("keyword_ord", F.floor(F.col("line_no") / WINDOW_TILE)))
    )
    levels = ["edition_date", "_file", "_lines"]
    ranked = ordered_rank(keyed, [], levels, ["line_no"], "id")
    return ranked.withColumn("id", (F.col("id") + highest + 1).cast(T.LongType())).drop("_file", "_lines")
