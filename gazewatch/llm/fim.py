"""Fill-in-the-middle transformation over remembered content-defined chunks.

A rolling hash of the last 32 bytes cuts each text into chunks, so that copies of a passage
are cut alike wherever they stand. What a chunk adds to its text (its number of code points,
whether it holds a marker, and the bytes at its edges) is worked out once for each distinct
chunk and remembered. The summaries of a text's chunks combine into that of the whole text;
their counts, added up, tell in which chunk a cut lies, and only that chunk is searched.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator
from functools import lru_cache, reduce
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazewatch.llm.common import slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKERS = tuple(m.encode() for m in (PREFIX, SUFFIX, MIDDLE))
#: Of 100 documents so many keep their text; of 100 others so many begin with the suffix.
PLAIN_PERCENT, SPM_PERCENT = 10, 20

WINDOW = 32
LEAST, MOST = 64, 2048
#: One place in 256 ends a chunk.
CUT_BITS = 8
BLOCK = 1 << 20
BATCH_BYTES = 500_000
MEMO_BYTES = 24 << 20

#: Random words for the 256 bytes, the same in every process.
_GEAR = np.random.default_rng(20240611).integers(0, 1 << 32, 256, dtype=np.uint32)


class Summary(NamedTuple):
    """What is known of a run of text: all that is needed to combine it with its neighbours."""

    points: int
    marked: bool
    head: bytes
    tail: bytes


EMPTY = Summary(0, False, b"", b"")


def summary_of(chunk: bytes) -> Summary:
    return Summary(len(chunk.decode()), any(m in chunk for m in MARKERS), chunk[:2], chunk[-2:])


def combined(a: Summary, b: Summary) -> Summary:
    """The summary of two neighbours. A marker across their edge shows in the edge's bytes."""
    edge = a.tail + b.head
    marked = a.marked or b.marked or any(m in edge for m in MARKERS)
    return Summary(a.points + b.points, marked, (a.head + b.head)[:2], (a.tail + b.tail)[-2:])


class ChunkMemo(dict):
    """Summaries by chunk. A chunk is found by its hash and confirmed by its whole content,
    as keys of a dictionary are; beyond a number of bytes the memo starts anew."""

    def __init__(self, bound: int = MEMO_BYTES):
        super().__init__()
        self.bound, self.held = bound, 0

    def __missing__(self, chunk: bytes) -> Summary:
        self.held += len(chunk) + 300
        if self.held > self.bound:
            self.clear()
            self.held = len(chunk) + 300
        self[chunk] = found = summary_of(chunk)
        return found


def cut_places(data: np.ndarray) -> np.ndarray:
    """Places before which the hash of the last 32 bytes ends a chunk, at starts of code points.

    Computed block by block. Where every place would do, as in a run of one byte, only the
    first counts.
    """
    found = []
    for begin in range(0, len(data), BLOCK):
        low = max(0, begin - WINDOW)
        part = data[low : begin + BLOCK]
        rolled, width = _GEAR[part], 1
        while width < WINDOW:  # the hash of `width` bytes, then of twice as many
            twice = rolled.copy()
            twice[width:] += rolled[:-width] << np.uint32(width)
            rolled, width = twice, 2 * width
        ends = (rolled >> np.uint32(32 - CUT_BITS)) == 0
        ends[1:] &= ~ends[:-1].copy()
        places = np.flatnonzero(ends[begin - low :]) + begin + 1
        places = places[places < len(data)]
        found.append(places[(data[places] & 0xC0) != 0x80].astype(np.int32))
    return np.concatenate(found) if found else np.zeros(0, dtype=np.int32)


def chunk_limits(data: np.ndarray, start: int, end: int, places: np.ndarray) -> list[int]:
    """The limits of the chunks of one text, which lies at [start, end) of the data.

    A chunk is longer than the hash's window, so it follows from bytes of its own text only,
    and at most MOST bytes long, or a code point more.
    """
    limits = [start]
    while end - limits[-1] > LEAST:
        last = limits[-1]
        at = int(places.searchsorted(last + LEAST))
        cut = min(int(places[at]) if at < len(places) else end, last + MOST, end)
        while cut < end and data[cut] & 0xC0 == 0x80:
            cut += 1
        limits.append(cut)
    if limits[-1] < end:
        limits.append(end)
    return limits


class Text:
    """A text as its chunks: the summary of the whole, and where a code point begins."""

    def __init__(self, whole: bytes, limits: list[int], memo: ChunkMemo):
        self.whole, self.limits = whole, limits
        parts = [memo[whole[a:b]] for a, b in zip(limits, limits[1:], strict=False)]
        self.before = list(accumulate((p.points for p in parts), initial=0))
        self.summary = reduce(combined, parts, EMPTY)

    def byte_of(self, point: int) -> int:
        """Where the code point with this number begins, or the text ends."""
        if point >= self.before[-1]:
            return self.limits[-1]
        i = bisect_right(self.before, point) - 1
        chunk = self.whole[self.limits[i] : self.limits[i + 1]].decode()
        return self.limits[i] + len(chunk[: point - self.before[i]].encode())


def rearranged(text: Text, draws: list[int], plain: int, spm: int) -> tuple[int, str, int | None, int | None, bytes]:
    """(code points, form, prefix and middle code points, output) of one text."""
    n, marked = text.summary.points, text.summary.marked
    if n == 0 or marked or draws[2] % 100 >= 100 - plain:
        return n, "plain", None, None, text.whole
    first, second = sorted((draws[0] % (n + 1), draws[1] % (n + 1)))
    a, b = text.byte_of(first), text.byte_of(second)
    opens, closes, fills = MARKERS
    prefix, middle, suffix = text.whole[:a], text.whole[a:b], text.whole[b:]
    if draws[3] % 100 < spm:
        return n, "spm", first, second - first, closes + suffix + opens + prefix + fills + middle
    return n, "psm", first, second - first, opens + prefix + closes + suffix + fills + middle


@lru_cache(maxsize=1)
def _memo() -> ChunkMemo:
    """One per worker process."""
    return ChunkMemo()


def transform(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    seed: int = 1,
    plain_percent: int = PLAIN_PERCENT,
    spm_percent: int = SPM_PERCENT,
) -> DataFrame:
    """doc_id, n (code points), form, prefix_chars, middle_chars and output of every row.

    The cuts and the form follow from `seed` and the doc_id alone; a null doc_id counts as an
    empty string there, and rows that share an id are cut by the same draws. Null and empty
    texts, and texts that hold a marker, are plain: the output is the text, the lengths of the
    parts are null. Repeated rows give repeated rows, an empty table none. Other columns are
    not read. One narrow stage; a task holds a batch of texts, or one long text, and a memo of
    bounded size. The result does not depend on how texts are cut into chunks.
    """
    id_type = docs.schema[doc_id].dataType.simpleString()

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _memo()
        for batch in slices(batches, "text", BATCH_BYTES):
            texts = batch.column("text").fill_null("").cast(pa.binary()).to_pylist()
            data = np.frombuffer(b"".join(texts), dtype=np.uint8)
            places, end, rows = cut_places(data), 0, []
            for whole, digest in zip(texts, batch.column("digest").to_pylist(), strict=True):
                start, end = end, end + len(whole)
                limits = [p - start for p in chunk_limits(data, start, end, places)]
                draws = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
                rows.append(rearranged(Text(whole, limits, memo), draws, plain_percent, spm_percent))
            n, form, prefix, middle, output = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(n, pa.int64()),
                    pa.array(form),
                    pa.array(prefix, pa.int64()),
                    pa.array(middle, pa.int64()),
                    pa.array(output, pa.binary()).cast(pa.string()),
                ],
                names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.sha2(key, 256).alias("digest")
    )
    made = "n long, form string, prefix_chars long, middle_chars long, output string"
    return rows.mapInArrow(work, f"doc_id {id_type}, {made}")


def restored(output: Column, form: Column) -> Column:
    """The text, from an output and its form.

    A text with a marker is plain, and no marker can begin in one part and end in the marker
    after it, so the three markers of an output are those put there.
    """
    part = F.split(output, "<[PSM]>", -1)
    one, two, three = (F.get(part, i) for i in (1, 2, 3))
    return (
        F.when(form == "psm", F.concat(one, three, two))
        .when(form == "spm", F.concat(two, three, one))
        .otherwise(output)
    )
