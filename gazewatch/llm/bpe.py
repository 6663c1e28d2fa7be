"""Token counts by byte-pair merging with a heap of ranks over a linked list of symbols."""

from __future__ import annotations

import heapq
import json
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazewatch.llm.common import Memo, slices
from gazewatch.llm.memo import PieceMemo, laid_out, white_space

BATCH_BYTES = 500_000
MEMO_WORDS = 300_000
PLACE_BITS = 40
PLACE_MASK = (1 << PLACE_BITS) - 1


def byte_letters() -> list[str]:
    """The printable stand-in of every byte in byte-level vocabularies, built by its rule."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters, spare = [""] * 256, 256
    for b in range(256):
        if b in plain:
            letters[b] = chr(b)
        else:
            letters[b], spare = chr(spare), spare + 1
    return letters


def merged_length(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """Initial symbols minus merges.

    The heap yields the adjacent pair of the lowest rank, the leftmost of equals; a merge
    takes the right symbol out of the list and offers the two new pairs. Entries whose
    symbols have changed meanwhile are passed over.
    """
    n = len(symbols)
    # An entry is one number, the rank above the place; what it stands for is seen at the place.
    heap = [
        rank << PLACE_BITS | i
        for i, pair in enumerate(zip(symbols, symbols[1:], strict=False))
        if (rank := ranks.get(pair)) is not None
    ]
    if not heap:
        return n
    heapq.heapify(heap)
    symbols = list(symbols)
    after, before, merges = array("q", range(1, n + 1)), array("q", range(-1, n - 1)), 0
    while heap:
        entry = heapq.heappop(heap)
        i = entry & PLACE_MASK
        j = after[i]
        if not symbols[i] or j >= n or ranks.get((symbols[i], symbols[j])) != entry >> PLACE_BITS:
            continue
        symbols[i], symbols[j] = symbols[i] + symbols[j], ""
        after[i] = k = after[j]
        merges += 1
        if k < n:
            before[k] = i
            if (rank := ranks.get((symbols[i], symbols[k]))) is not None:
                heapq.heappush(heap, rank << PLACE_BITS | i)
        if (h := before[i]) >= 0 and (rank := ranks.get((symbols[h], symbols[i]))) is not None:
            heapq.heappush(heap, rank << PLACE_BITS | h)
    return n - merges


class Counter:
    """Counts the tokens of texts as the vocabulary file's library does.

    Reads the parts of a tokenizers file that lower-case byte-pair vocabularies with word
    ends have: composed normal form, white space and case folding, a pattern of words,
    byte letters, merges, special strings. White space separates words, so a text's count
    is the sum over its white-space pieces, which are remembered.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        if spec["model"]["type"] != "BPE" or not spec["model"].get("end_of_word_suffix"):
            raise ValueError("a byte-pair vocabulary with word ends is needed")
        self.end = spec["model"]["end_of_word_suffix"]
        self.ranks = {tuple(pair): i for i, pair in enumerate(spec["model"]["merges"])}
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        self.pattern = regex.compile(split["pattern"]["Regex"])
        special = [regex.escape(t["content"]) for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(special)) if special else None
        self.letters = byte_letters()
        self.words = Memo(self._count_words, MEMO_WORDS)
        self.pieces = PieceMemo(self._count_pieces)

    def _count_words(self, words: list[str]) -> Iterator[int]:
        for word in words:
            symbols = [self.letters[b] for b in word.encode()]
            symbols[-1] += self.end
            yield merged_length(symbols, self.ranks)

    def _parts(self, piece: str) -> tuple[list[str], int]:
        """The words of a piece without white space, and its special strings' number."""
        parts = self.special.split(piece) if self.special else [piece]
        words = []
        for part in parts:
            folded = "".join(c.lower() for c in unicodedata.normalize("NFC", part))
            words += self.pattern.findall(folded)
        return words, len(parts) - 1

    def _count_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        parts = [self._parts(p.decode()) for p in pieces]
        self.words.learn({w for words, _ in parts for w in words})
        counts = [sum(map(self.words.__getitem__, words)) + special for words, special in parts]
        return np.array(counts, dtype=np.uint32), np.ones(len(counts), dtype=np.int64)

    def count(self, texts: list[bytes]) -> np.ndarray:
        data, limits = laid_out(texts, b" ")
        edge = np.flatnonzero(np.diff(np.concatenate(([True], white_space(data), [True])).view(np.int8)))
        starts, ends = edge[::2], edge[1::2]
        counts, _ = self.pieces.take(data, starts, ends)
        total = np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))
        return np.diff(total[np.searchsorted(starts, limits)])


@lru_cache(maxsize=1)
def counter(path: str) -> Counter:
    """One per worker process: reading a vocabulary takes about a second."""
    return Counter(path)


def count_tokens(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes and n_tokens of every row, without emitting any identifier.

    `vocabulary` is a path that executors can read. Every input row gives one row, in one
    narrow stage; the memory of a task is bounded by a batch and a bounded memo of words.
    Null and empty texts have 0 bytes and 0 tokens; a null doc_id stays null.
    """
    id_type = docs.schema[doc_id].dataType.simpleString()

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary).count
        for batch in slices(batches, "text", BATCH_BYTES):
            texts = batch.column("text").fill_null("").cast(pa.binary())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.compute.binary_length(texts).cast(pa.int64()),
                    pa.array(count(texts.to_pylist())),
                ],
                names=["doc_id", "n_bytes", "n_tokens"],
            )

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(counted, f"doc_id {id_type}, n_bytes long, n_tokens long")
