"""Joins with small tables, and staging of tables that are read more than once."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A rule table up to this many rows and bytes is copied to every executor.
BROADCAST_ROWS = 10_000
BROADCAST_BYTES = 8 << 20


def fits_broadcast(rules: DataFrame, copies: Column | None = None) -> bool:
    """Whether a table is within the broadcast limits, in rows and in bytes.

    ``copies`` tells how many rows each row stands for. Only sizes are fetched, and
    reading stops one row past the limit, so this never touches a large table.
    """
    copies = F.lit(1) if copies is None else copies
    n_bytes = F.octet_length(F.to_json(F.struct("*")))
    sizes = rules.select(copies.alias("rows"), n_bytes.alias("bytes"))
    sizes = sizes.limit(BROADCAST_ROWS + 1).collect()
    return (
        sum(s.rows for s in sizes) <= BROADCAST_ROWS
        and sum(s.rows * s.bytes for s in sizes) <= BROADCAST_BYTES
    )


def join_rules(
    left: DataFrame,
    rules: DataFrame,
    condition: Column,
    how: str,
    small: bool | None = None,
) -> DataFrame:
    """Join on ``secao`` and a further condition between columns of both sides.

    A rule table is normally a few rows and is broadcast once its size is known;
    ``small`` says so if it was found out before. A larger one is joined by section as the
    planner sees fit; large sections are split there, by adaptive execution.
    """
    right = rules.withColumnRenamed("secao", "_secao")
    if fits_broadcast(rules) if small is None else small:
        right = F.broadcast(right)
    return left.join(right, (left["secao"] == right["_secao"]) & condition, how).drop("_secao")


_STAGING: ContextVar[str | None] = ContextVar("staging", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as the cluster names it in the session.

    A session on one machine may leave it out; its folder is then beside its tables.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if master == "local" or master.startswith("local["):
        return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_staged"
    raise ValueError("name a folder that all executors share in spark.checkpoint.dir")


@contextmanager
def staging(spark: SparkSession, folder: str) -> Iterator[None]:
    """What is staged inside goes to the folder, which is removed once all is done.

    If it fails, the folder stays, and the next try under the same name begins by removing it.
    """
    drop_folder(spark, folder)
    token = _STAGING.set(folder)
    try:
        yield
    finally:
        _STAGING.reset(token)
    drop_folder(spark, folder)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a table that several scans will read, and read it back.

    The copy outlives lost executors, cuts the lineage, and gives later scans
    column pruning, filter push-down and true sizes to plan with. A run has a folder of its
    own for its copies; others go to the shared folder.
    """
    spark = df.sparkSession
    path = f"{_STAGING.get() or shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def drop_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder of staged copies, in whatever store it is."""
    place, store = _place(spark, path)
    store.delete(place, True)


def move_folder(spark: SparkSession, path: str, to: str) -> None:
    """Rename a folder in one step; its new place must not exist."""
    place, store = _place(spark, path)
    target, _ = _place(spark, to)
    store.mkdirs(target.getParent())
    if store.exists(target) or not store.rename(place, target):
        raise RuntimeError(f"{to} is already there")


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """The names inside a folder; none if it does not exist."""
    place, store = _place(spark, path)
    return [s.getPath().getName() for s in store.listStatus(place)] if store.exists(place) else []
