"""Exchange of hashed findings between blocks of documents and buckets of hashes.

A block is a set of documents that one task holds; a bucket is a share of the hash space.
Blocks send each distinct finding once, whatever its number of copies, so a passage that a
third of all rows hold costs a bucket one entry per block. Findings travel as packed
arrays, one row for each block and bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazewatch.llm.common import give_back, partitions

#: Blocks for each shuffle partition: a task takes them one after the other.
BLOCKS_PER_PARTITION = 4


def in_blocks(docs: DataFrame, doc_id: str, text: str, digest: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """block, doc_id, text, a digest if asked for, and carried columns of every row, dealt by block.

    The block follows from the row alone, so a lost task finds the same rows again. All
    passes of an operator read this one exchange.
    """
    n = partitions(docs.sparkSession)
    key = F.xxhash64(F.col(doc_id), F.col(text))
    return docs.select(
        F.pmod(key, F.lit(n * BLOCKS_PER_PARTITION)).cast("int").alias("block"),
        F.col(doc_id).alias("doc_id"),
        F.col(text).alias("text"),
        *[key.alias("digest")] * digest,
        *[F.col(c) for c in carry],
    ).repartition(n, "block")


def bucket_rows(block: int, buckets: int, keys: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    """(bucket, block, keys, *columns) with the keys of one bucket, as bytes."""
    at = (keys % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(at, kind="stable")
    limits = np.searchsorted(at[order], np.arange(buckets + 1))
    for bucket in np.flatnonzero(np.diff(limits)).tolist():
        chosen = order[limits[bucket] : limits[bucket + 1]]
        yield (bucket, block, keys[chosen].tobytes(), *[c[chosen].tobytes() for c in columns])


def joined(column: pa.ChunkedArray, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a column of packed arrays, and the row that each is from."""
    parts = [np.frombuffer(b, dtype=dtype) for b in column.to_pylist()]
    if not parts:
        return np.zeros(0, dtype=dtype), np.zeros(0, dtype=np.int64)
    return np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(p) for p in parts])


def table_of(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    give_back()
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def by_group(groups: np.ndarray) -> np.ndarray:
    """The starts of runs of equal neighbours, and the end."""
    if not len(groups):
        return np.zeros(1, dtype=np.int64)
    return np.concatenate(([0], np.flatnonzero(groups[1:] != groups[:-1]) + 1, [len(groups)]))
