"""Small helpers that several operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gazewatch.functions.sizing import shared_folder

#: The characters that end a word: space, and tab to carriage return.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_CLASS = "[\\x20\\x09-\\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blank_words(text: Column) -> Column:
    """The words of a text, split at blanks only; a null or blank text has none."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(
        F.split(inner, BLANK_CLASS + "+")
    )


def slices(batches: Iterable[pa.RecordBatch], text: str, size: int) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each piece has `size` bytes of text, or is a single row."""
    for batch in batches:
        lengths = pa.compute.binary_length(batch.column(text)).fill_null(0).to_pylist()
        start = held = 0
        for i, length in enumerate(lengths):
            if held and held + length > size:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += length
        if start < batch.num_rows:
            yield batch.slice(start)
        give_back()


def give_back() -> None:
    """Hand freed memory back to the system, so that a worker between tasks stays small."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # a C library that does so by itself
        pass


def partitions(spark: SparkSession) -> int:
    """How many shuffle partitions the session's owner has sized for its data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class Memo(dict):
    """Results by word, computed for all unknown words of a batch at once.

    It holds at most `bound` words of `most_chars` in all; beyond that it starts anew with the
    words of the batch, so a task's memory does not depend on its input.
    """

    def __init__(self, compute: Callable[[list[str]], Iterable], bound: int, most_chars: int = 16 << 20):
        super().__init__()
        self.compute, self.bound, self.most_chars, self.held = compute, bound, most_chars, 0

    def learn(self, words: set[str]) -> None:
        unknown = [w for w in words if w not in self]
        if len(self) + len(unknown) > self.bound or self.held + sum(map(len, unknown)) > self.most_chars:
            self.clear()
            self.held, unknown = 0, list(words)
        if unknown:
            self.held += sum(map(len, unknown))
            self.update(zip(unknown, self.compute(unknown), strict=True))


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares for such files: the one in spark.checkpoint.dir."""
    return shared_folder(spark)


def checkpointed(df: DataFrame) -> DataFrame:
    """The same rows, read from the folder that the cluster shares; their lineage ends there."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(checkpoint_folder(df.sparkSession))
    return df.checkpoint()
