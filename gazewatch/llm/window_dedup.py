"""Substring dedup by difference-cover anchors.

Take a set D of residues modulo V in which every difference modulo V occurs. For any two
places i and j there is a shift d < V that puts both i + d and j + d on residues of D. So
two equal windows of L words share an anchor: W = L - V + 1 words at a place whose number
in its document has a residue in D. Only anchors are hashed and exchanged at first; the
windows around those that repeat are then compared in full.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gazewatch.llm.blocks import bucket_rows, by_group, in_blocks, joined, table_of
from gazewatch.llm.common import partitions
from gazewatch.llm.hashing import Prefixes, Words, among, mixed

WINDOW = 35
#: Perfect difference sets modulo 7, 13, 21 and 31: each difference occurs once.
COVERS = {7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}
CHUNK_BYTES = 250_000


@dataclass(frozen=True)
class Cover:
    window: int

    @property
    def period(self) -> int:
        """The longest known period that leaves anchors of two fifths of the window."""
        fitting = [v for v in COVERS if self.window - v + 1 >= 0.4 * self.window]
        return max(fitting, default=1)

    @property
    def anchor(self) -> int:
        return self.window - self.period + 1

    def holds(self, places: np.ndarray) -> np.ndarray:
        residues = np.zeros(self.period, dtype=bool)
        residues[list(COVERS.get(self.period, (0,)))] = True
        return residues[places % self.period]


def _chunks(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    start = held = 0
    for i, text in enumerate(texts):
        if held and held + len(text) > CHUNK_BYTES:
            yield start, texts[start:i]
            start, held = i, 0
        held += len(text)
    if start < len(texts):
        yield start, texts[start:]


def _texts(rows: pa.Table) -> list[bytes]:
    return [t or b"" for t in rows.column("text").cast(pa.binary()).to_pylist()]


def _anchors(words: Words, cover: Cover) -> tuple[np.ndarray, np.ndarray]:
    """Places (in the chunk) and hashes of the anchors."""
    fits = words.fits(cover.anchor)
    at = np.flatnonzero(fits & cover.holds(words.place[: len(fits)]))
    return at, Prefixes(words.hashes).runs(at, at + cover.anchor)


def _windows(words: Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of each window, 64 and 32 bits, by start."""
    first = Prefixes(words.hashes).every(window)
    second = Prefixes(mixed(words.hashes + np.uint64(0x5851F42D4C957F2D))).every(window)
    return first, (second >> np.uint64(32)).astype(np.uint32)


PAIR = np.dtype([("h", "<u8"), ("c", "<u4")])


def _pairs(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    pairs = np.empty(len(h), dtype=PAIR)
    pairs["h"], pairs["c"] = h, c
    return pairs


def _distinct(h: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs in order, and which of them occur twice or more."""
    order = np.lexsort((c, h))
    h, c = h[order], c[order]
    edge = by_group(_pairs(h, c))
    return h[edge[:-1]], c[edge[:-1]], np.diff(edge) > 1


def _known(h: np.ndarray, c: np.ndarray, sorted_h: np.ndarray, sorted_c: np.ndarray) -> np.ndarray:
    """Which pairs are among sorted pairs; equal first hashes with other seconds may follow."""
    if not len(sorted_h):
        return np.zeros(len(h), dtype=bool)
    last = len(sorted_h) - 1
    at = np.minimum(np.searchsorted(sorted_h, h), last)
    found = np.zeros(len(h), dtype=bool)
    todo = np.flatnonzero(sorted_h[at] == h)
    while len(todo):  # more than once only where 64 bits collide
        equal = sorted_c[at[todo]] == c[todo]
        found[todo[equal]] = True
        todo = todo[~equal & (at[todo] < last)]
        at[todo] += 1
        todo = todo[sorted_h[at[todo]] == h[todo]]
    return found


def _schema(**fields: str) -> tuple[str, pa.Schema]:
    kinds = {"int": pa.int32(), "binary": pa.binary(), "long": pa.int64(), "string": pa.string()}
    return ", ".join(f"{k} {v}" for k, v in fields.items()), pa.schema([(k, kinds[v]) for k, v in fields.items()])


def remove_repeats(docs: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, kept (the words left, joined by a space), n_words and n_removed of every row.

    A word goes if a window of `window` words covers it whose words also start elsewhere, in
    another row or in the same one; windows are those of the input. Words are what blanks
    (space, tab to carriage return) part. Null, empty and short texts have no window and
    lose nothing; an identical repeated row is another place, so both lose their words.

    Three passes read one exchange of the texts by block. Anchors, then windows around
    repeated anchors, go to buckets of the hash space as distinct hashes of a block, so no
    task gathers the places of a frequent passage. Windows are told apart by 96 bits.
    """
    cover, buckets = Cover(window), partitions(docs.sparkSession)
    blocks = in_blocks(docs, doc_id, text)
    id_type = docs.schema[doc_id].dataType.simpleString()
    sent, sent_arrow = _schema(bucket="int", block="int", keys="binary", twice="binary")
    reply, reply_arrow = _schema(block="int", keys="binary")
    pairs_sent, pairs_arrow = _schema(bucket="int", block="int", keys="binary", checks="binary", twice="binary")
    pairs_reply, pairs_reply_arrow = _schema(block="int", keys="binary", checks="binary")

    def send_anchors(rows: pa.Table) -> pa.Table:
        found = [_anchors(Words(part), cover)[1] for _, part in _chunks(_texts(rows))]
        keys, counts = np.unique(np.concatenate(found), return_counts=True)
        block = rows.column("block")[0].as_py()
        return table_of(list(bucket_rows(block, buckets, keys, counts > 1)), sent_arrow)

    def repeated_anchors(rows: pa.Table) -> pa.Table:
        keys, source = joined(rows.column("keys"), "<u8")
        twice, _ = joined(rows.column("twice"), "?")
        order = np.argsort(keys, kind="stable")
        edge = by_group(keys[order])
        several = (np.diff(edge) > 1) | np.logical_or.reduceat(twice[order], edge[:-1])
        return _replies(rows, source[order], np.repeat(several, np.diff(edge)), reply_arrow, keys[order])

    def send_windows(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        if not rows.num_rows or not anchors.num_rows:
            return table_of([], pairs_arrow)
        known = np.sort(joined(anchors.column("keys"), "<u8")[0])
        found = []
        for _, part in _chunks(_texts(rows)):
            words = Words(part)
            at, keys = _anchors(words, cover)
            near = np.zeros(len(words.hashes) + 1, dtype=np.int32)
            at = at[among(keys, known)]
            np.add.at(near, np.maximum(at - cover.period + 1, 0), 1)
            np.add.at(near, at + 1, -1)
            fits = words.fits(window)
            starts = np.flatnonzero(fits & (np.cumsum(near)[: len(fits)] > 0))
            if len(starts):
                h, c = _windows(words, window)
                found.append((h[starts], c[starts]))
        if not found:
            return table_of([], pairs_arrow)
        h, c, twice = _distinct(*[np.concatenate(x) for x in zip(*found, strict=True)])
        block = rows.column("block")[0].as_py()
        return table_of(list(bucket_rows(block, buckets, h, c, twice)), pairs_arrow)

    def repeated_windows(rows: pa.Table) -> pa.Table:
        h, source = joined(rows.column("keys"), "<u8")
        c, _ = joined(rows.column("checks"), "<u4")
        twice, _ = joined(rows.column("twice"), "?")
        order = np.lexsort((c, h))
        h, c = h[order], c[order]
        edge = by_group(_pairs(h, c))
        several = (np.diff(edge) > 1) | np.logical_or.reduceat(twice[order], edge[:-1])
        chosen = np.repeat(several, np.diff(edge))
        return _replies(rows, source[order], chosen, pairs_reply_arrow, h, c)

    def remove(rows: pa.Table, windows: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return table_of([], kept_arrow)
        known_h, _ = joined(windows.column("keys"), "<u8")
        known_c, _ = joined(windows.column("checks"), "<u4")
        order = np.lexsort((known_c, known_h))
        known_h, known_c = known_h[order], known_c[order]
        texts, out = _texts(rows), []
        for start, part in _chunks(texts):
            words = Words(part)
            fits = words.fits(window)
            gone = np.zeros(len(words.hashes) + 1, dtype=np.int32)
            if len(known_h) and len(fits):
                h, c = _windows(words, window)
                starts = np.flatnonzero(fits & _known(h, c, known_h, known_c))
                np.add.at(gone, starts, 1)
                np.add.at(gone, starts + window, -1)
            gone = np.cumsum(gone)[:-1] > 0
            for i, text in enumerate(part):
                spoken, lost = text.split(), gone[words.first[i] : words.first[i + 1]]
                kept = [spoken[k] for k in np.flatnonzero(~lost)] if lost.any() else spoken
                out.append((start + i, b" ".join(kept).decode(), len(spoken), int(lost.sum())))
        kept = table_of([(t, n, r) for _, t, n, r in out], pa.schema(list(kept_arrow)[1:]))
        return kept.add_column(0, "doc_id", rows.column("doc_id"))

    kept_arrow = pa.schema(
        [("doc_id", _arrow_type(docs, doc_id)), ("kept", pa.string()), ("n_words", pa.int64()), ("n_removed", pa.int64())]
    )
    anchors = blocks.groupBy("block").applyInArrow(send_anchors, sent)
    anchors = anchors.groupBy("bucket").applyInArrow(repeated_anchors, reply)
    windows = blocks.groupBy("block").cogroup(anchors.groupBy("block")).applyInArrow(send_windows, pairs_sent)
    windows = windows.groupBy("bucket").applyInArrow(repeated_windows, pairs_reply)
    return (
        blocks.groupBy("block")
        .cogroup(windows.groupBy("block"))
        .applyInArrow(remove, f"doc_id {id_type}, kept string, n_words long, n_removed long")
    )


def _arrow_type(docs: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(docs.schema[column].dataType)


def _replies(rows: pa.Table, source: np.ndarray, chosen: np.ndarray, schema: pa.Schema, *columns: np.ndarray) -> pa.Table:
    """To each block, the chosen of the findings that it had sent."""
    blocks = np.array(rows.column("block").to_pylist(), dtype=np.int64)[source[chosen]]
    order = np.argsort(blocks, kind="stable")
    edge, blocks = by_group(blocks[order]), blocks[order]
    columns = [c[chosen][order] for c in columns]
    return table_of(
        [
            (int(blocks[a]), *[c[a:b].tobytes() for c in columns])
            for a, b in zip(edge[:-1], edge[1:], strict=True)
        ],
        schema,
    )
