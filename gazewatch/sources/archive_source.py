"""Edition archives as a data source: ``spark.read.format("edition_archives").load(folder)``.

Rows are the XML members of all archives in a folder. The driver lists names and lengths only
and plans input partitions of about ``partBytes`` bytes: small archives share one, a large one
is read by several tasks, each taking the members that begin in its stretch of the file. A
schema without ``xml`` reads directories but no content, and filters on section, day and name
leave whole archives out. SQL reads it through a table or view ``USING edition_archives``.
"""

from __future__ import annotations

import os
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date
from urllib.parse import urlparse

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

from gazewatch import schemas
from gazewatch.sources.archives import open_seekable

NAME = re.compile(r"(\d{4})-(\d{2})-(\d{2})-DO(\d+)E?\.zip")
PART_BYTES = 8 << 20


@dataclass(frozen=True)
class Archive:
    file_name: str
    secao: str
    edition_date: date
    path: str
    length: int


@dataclass(frozen=True)
class Stretch(InputPartition):
    """Members of archives that begin in [low, high) of each."""

    archives: tuple[Archive, ...]
    low: int
    high: int


def listed(folder: str) -> Iterator[tuple[str, int]]:
    """Paths and lengths of all files below a folder, local or in a store that Arrow reads."""
    address = urlparse(folder)
    if address.scheme in ("", "file"):
        for at, _, names in os.walk(address.path if address.scheme else folder):
            yield from ((path, os.path.getsize(path)) for path in (os.path.join(at, n) for n in names))
        return
    from pyarrow import fs

    store, inside = fs.FileSystem.from_uri(folder.replace("s3a://", "s3://", 1))
    for info in store.get_file_info(fs.FileSelector(inside, recursive=True)):
        if info.type == fs.FileType.File:
            yield f"{address.scheme}://{info.path}", info.size


def archives_in(folder: str) -> list[Archive]:
    found = []
    for path, length in listed(folder):
        name = path.rsplit("/", 1)[-1]
        if m := NAME.fullmatch(name):
            try:
                day = date(int(m[1]), int(m[2]), int(m[3]))
            except ValueError:
                continue
            found.append(Archive(name, f"DO{m[4]}", day, path, length))
    return sorted(found, key=lambda a: (a.edition_date, a.file_name, a.path))


def planned(archives: list[Archive], part_bytes: int) -> list[Stretch]:
    """Partitions of about so many bytes: several archives, or a stretch of one."""
    stretches: list[Stretch] = []
    held: list[Archive] = []
    whole = 1 << 62
    for archive in archives:
        if archive.length > part_bytes:
            parts = -(-archive.length // part_bytes)
            limits = [archive.length * i // parts for i in range(parts)] + [whole]
            stretches += [Stretch((archive,), a, b) for a, b in zip(limits, limits[1:], strict=False)]
            continue
        if held and sum(a.length for a in held) + archive.length > part_bytes:
            stretches.append(Stretch(tuple(held), 0, whole))
            held = []
        held.append(archive)
    return stretches + ([Stretch(tuple(held), 0, whole)] if held else [])


class ArchiveReader(DataSourceReader):
    def __init__(self, schema: StructType, folder: str, part_bytes: int):
        self.columns, self.folder, self.part_bytes = schema.names, folder, part_bytes
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes equality with constants for what names tell; Spark keeps the others."""
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is None or len(f.attribute) != 1 or f.attribute[0] not in ("secao", "edition_date", "file_name"):
                yield f
            else:
                column = f.attribute[0]
                self.wanted[column] = self.wanted.get(column, values) & values

    def partitions(self) -> list[Stretch]:
        archives = [
            a for a in archives_in(self.folder) if all(getattr(a, c) in values for c, values in self.wanted.items())
        ]
        return planned(archives, self.part_bytes)

    def read(self, partition: Stretch) -> Iterator[tuple]:
        for archive in partition.archives:
            row = {"file_name": archive.file_name, "secao": archive.secao, "edition_date": archive.edition_date}
            try:
                with open_seekable(archive.path) as raw, zipfile.ZipFile(raw) as opened:
                    for i, member in enumerate(opened.infolist()):
                        inside = partition.low <= member.header_offset < partition.high
                        if not inside or not member.filename.lower().endswith(".xml"):
                            continue
                        if "xml" in self.columns:
                            row["xml"] = opened.read(member).decode("utf-8", errors="ignore")
                        yield tuple((row | {"entry_no": i, "err": None})[c] for c in self.columns)
            except Exception as problem:  # a bad file must not stop the others
                if partition.low == 0:
                    failed = row | {"entry_no": None, "xml": None, "err": f"{type(problem).__name__}: {problem}"}
                    yield tuple(failed[c] for c in self.columns)


class EditionArchives(DataSource):
    @classmethod
    def name(cls) -> str:
        return "edition_archives"

    def schema(self) -> StructType:
        return schemas.ENTRIES

    def reader(self, schema: StructType) -> ArchiveReader:
        unknown = set(schema.names) - set(schemas.ENTRIES.names)
        if unknown:
            raise ValueError(f"archives have no column {', '.join(sorted(unknown))}")
        return ArchiveReader(schema, self.options["path"], int(self.options.get("partbytes", PART_BYTES)))


def register(spark: SparkSession) -> None:
    """Make the format known to a session, and let it be handed filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(EditionArchives)
