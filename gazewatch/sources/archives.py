"""Edition archives. The only Python kernels of the engine: Spark has no ZIP source.

Archives are read by the tasks from shared storage, member by member. First the
directory at the end of each file is listed, then the members are spread over the
cluster, so one very large archive is opened by many tasks at once.
"""

from __future__ import annotations

import zipfile
from collections.abc import Iterator
from itertools import groupby
from urllib.parse import urlparse

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazewatch import schemas
from gazewatch.functions import text as X

# Unpacked members of so many bytes are read in one go by a task, and handed on together.
PART_BYTES = 8 << 20


def open_seekable(path: str):
    """A seekable file for a local path or for any storage address Arrow can read."""
    address = urlparse(path)
    if address.scheme in ("", "file"):
        return open(address.path if address.scheme else path, "rb")
    from pyarrow import fs

    store, inside = fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
    return store.open_input_file(inside)


def _error(problem: Exception) -> str:
    return f"{type(problem).__name__}: {problem}"


def _table(rows: list[tuple], schema) -> pd.DataFrame:
    whole = {f.name: "Int64" for f in schema.fields if f.dataType.typeName() == "long"}
    return pd.DataFrame(rows, columns=schema.names).astype(whole)


def _list_members(batches: Iterator[pd.DataFrame], part_bytes: int) -> Iterator[pd.DataFrame]:
    """Members with the part of their archive that they belong to, by their sizes."""
    for batch in batches:
        for file in batch.itertuples(index=False):
            head = (file.file_name, file.secao, file.edition_date, file.path)
            rows, size = [], 0
            try:
                with open_seekable(file.path) as raw, zipfile.ZipFile(raw) as archive:
                    for i, member in enumerate(archive.infolist()):
                        if member.filename.lower().endswith(".xml"):
                            rows.append((*head, i, size // part_bytes, None))
                            size += member.file_size
            except Exception as problem:  # a bad file must not stop the others
                rows = [(*head, None, None, _error(problem))]
            yield _table(rows, schemas.ENTRY_INDEX)


def _read_members(batches: Iterator[pd.DataFrame], part_bytes: int) -> Iterator[pd.DataFrame]:
    """The members' content. Files that could not be listed pass through with their error."""
    for batch in batches:
        out, held = [], 0
        rows = batch.astype({"err": object}).itertuples(index=False)
        for (name, secao, day, path), wanted in groupby(rows, key=lambda r: tuple(r)[:4]):
            head, wanted = (name, secao, day), list(wanted)
            if isinstance(wanted[0].err, str):
                out.append((*head, None, None, wanted[0].err))
                continue
            try:
                with open_seekable(path) as raw, zipfile.ZipFile(raw) as archive:
                    members = archive.infolist()
                    for row in wanted:
                        xml = archive.read(members[int(row.entry_no)]).decode("utf-8", errors="ignore")
                        out.append((*head, row.entry_no, xml, None))
                        held += len(xml)
                        if held >= part_bytes:
                            yield _table(out, schemas.ENTRIES)
                            out, held = [], 0
            except Exception as problem:
                out.append((*head, None, None, _error(problem)))
        if out:
            yield _table(out, schemas.ENTRIES)


# An archive's text is some times as long as the archive.
UNPACKED = 4
MOST_TASKS = 100_000


def tasks_for(files: DataFrame, part_bytes: int) -> int:
    """How many tasks read archives, by their lengths: one for each part of the unpacked text."""
    total = files.agg(F.sum("length")).first()[0] if "length" in files.columns else None
    if total is None:
        return int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, min(MOST_TASKS, total * UNPACKED // part_bytes + 1))


def archive_entries(files: DataFrame, tasks: int | None = None, part_bytes: int = PART_BYTES) -> DataFrame:
    """One row per XML member of each archive; a file that cannot be read gives an ``err`` row.

    Every directory is read once. Neighbouring members of ``part_bytes`` stay together and share
    one opening of the file. The number of tasks follows from the lengths of the files: names
    are tiny and would be merged into one partition by their size, but the work behind each is
    large.
    """
    archives = files.where(F.endswith(F.col("file_name"), F.lit(".zip")))
    tasks = tasks or tasks_for(archives, part_bytes)
    named = archives.select("file_name", "secao", "edition_date", "path")
    index = named.repartition(tasks, "path").mapInPandas(
        lambda batches: _list_members(batches, part_bytes), schemas.ENTRY_INDEX
    )
    spread = index.repartition(tasks, "path", "part").sortWithinPartitions("path", "entry_no")
    return spread.mapInPandas(lambda batches: _read_members(batches, part_bytes), schemas.ENTRIES)


def entry_pages(entries: DataFrame) -> DataFrame:
    """Members as pages: markup removed, so each is a single line of text."""
    return entries.select(
        "file_name",
        "secao",
        "edition_date",
        F.col("entry_no").alias("page_no"),
        X.strip_markup(F.col("xml")).alias("text"),
        "err",
    )
