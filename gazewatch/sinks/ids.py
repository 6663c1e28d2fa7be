"""Ranges of row ids, handed out to runs once and for all.

Each range is a small file, named by a number one above the last and created only if no file
has that name, so that of two runs that reach for the same range one takes the next. A range
is spent when it is handed out: a run that fails or is repeated never gives ids of its own to
another. Only the last few files are kept.
"""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

KEPT = 100


def reserve(spark: SparkSession, folder: str, n: int, run_id: str) -> int:
    """The first of n consecutive ids, counted from 1. None are spent on a run without rows."""
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(folder)
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(place)
    while True:
        names = sorted(s.getPath().getName() for s in store.listStatus(place) if not s.getPath().getName().startswith("."))
        last, used = (int(names[-1]), _used(jvm, store, place, names[-1])) if names else (0, 0)
        if n == 0:
            return used + 1
        try:
            out = store.create(jvm.org.apache.hadoop.fs.Path(place, f"{last + 1:012}"), False)
        except Py4JJavaError as problem:
            if "FileAlreadyExists" in problem.java_exception.getClass().getName():
                continue
            raise
        out.write(f"{used + n}\n{run_id}\n".encode())
        out.close()
        for name in names[:-KEPT]:
            store.delete(jvm.org.apache.hadoop.fs.Path(place, name), False)
        return used + 1


def _used(jvm, store, place, name: str) -> int:
    """The highest id that has been handed out."""
    source = store.open(jvm.org.apache.hadoop.fs.Path(place, name))
    try:
        text = jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
    finally:
        source.close()
    if not text.endswith("\n"):
        raise RuntimeError(f"the range of ids in {place}/{name} is being written or was cut short")
    return int(text.split("\n")[0])
