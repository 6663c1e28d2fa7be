"""Pieces by the best path (Viterbi) over a double-array trie, with byte fallback."""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazewatch.llm.common import slices
from gazewatch.llm.memo import PieceMemo, by_text, laid_out

BATCH_BYTES = 500_000
MARK = "▁"
#: How much worse than the rarest piece a character given as bytes is.
FALLBACK_PENALTY = 10.0
#: Longer units are followed one by one, so that a table of places stays small.
MOST_ABREAST, ABREAST_BYTES = 64, 1 << 20


class DoubleArray:
    """A trie in two arrays: the child of node s by byte c is t = base[s] + c + 1 if check[t] == s."""

    #: After so many vain tries, slots this far left are taken as full.
    TRIES = 64

    def __init__(self, keys: dict[bytes, int]):
        self.base, self.check, self.value = [0], [0], [-1]
        root: dict = {}
        for key, value in keys.items():
            node = root
            for byte in key:
                node = node.setdefault(byte, {})
            node[-1] = value
        stack, free = [(0, root)], 1
        while stack:
            at, node = stack.pop()
            self.value[at] = node.get(-1, -1)
            codes = [c + 1 for c in sorted(node) if c >= 0]
            if not codes:
                continue
            base, tries = max(0, free - codes[0]), 0
            self._grow(base + 258)
            while any(self.check[base + c] >= 0 for c in codes):
                base, tries = base + 1, tries + 1
                self._grow(base + 258)
            if tries > self.TRIES:
                free = base
            self.base[at] = base
            for c in codes:
                self.check[base + c] = at
                stack.append((base + c, node[c - 1]))

    def _grow(self, size: int) -> None:
        more = size - len(self.check)
        if more > 0:
            self.base += [0] * more
            self.check += [-1] * more
            self.value += [-1] * more

    def matches(self, key: bytes, start: int) -> Iterator[tuple[int, int]]:
        """(end, value) of every key that begins at `start`, the shortest first."""
        base, check, value, at = self.base, self.check, self.value, 0
        for i in range(start, len(key)):
            t = base[at] + key[i] + 1
            if t >= len(check) or check[t] != at:
                return
            at = t
            if value[at] >= 0:
                yield i + 1, value[at]


class Pieces:
    """A vocabulary of pieces with log scores, and its 256 byte pieces."""

    def __init__(self, pieces: dict[str, tuple[int, float]], byte_ids: list[int], size: int):
        self.trie = DoubleArray({p.replace(MARK, " ").encode(): i for p, (i, _) in pieces.items()})
        self.scores, self.byte_ids = [0.0] * size, byte_ids
        self.bytes = [b""] * size
        for piece, (i, score) in pieces.items():
            self.scores[i], self.bytes[i] = score, piece.replace(MARK, " ").encode()
        for byte, i in enumerate(byte_ids):
            self.bytes[i] = bytes([byte])
        self.fallback = min(s for _, s in pieces.values()) - FALLBACK_PENALTY
        self.longest = max(4, *map(len, self.bytes))
        self.tables = (
            np.array(self.trie.base, dtype=np.int32),
            # A slot past the end is no child of any node.
            np.array(self.trie.check + [-1] * 258, dtype=np.int32),
            np.array(self.trie.value, dtype=np.int32),
            np.array(self.scores),
        )

    def best_of(self, keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of `best` for every key, one after the other, and how many each has.

        Keys of one length go abreast: at each place the trie is walked for all of them.
        """
        lengths = np.array([len(k) for k in keys], dtype=np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []  # keys, and the ids of each, last one first
        order = np.argsort(lengths, kind="stable")
        edges = np.flatnonzero(np.diff(lengths[order], prepend=-1))
        for own in np.split(order, edges[1:]):
            n = int(lengths[own[0]])
            if n > MOST_ABREAST:
                for k in own.tolist():
                    ids = np.frombuffer(self.best(keys[k]), dtype=np.uint32)[::-1]
                    found.append((np.full(len(ids), k), ids))
                continue
            for i in range(0, len(own), ABREAST_BYTES // n):
                part = own[i : i + ABREAST_BYTES // n]
                block = np.frombuffer(b"".join([keys[k] for k in part.tolist()]), dtype=np.uint8)
                found += [(part[at], ids) for at, ids in self._abreast(block.reshape(len(part), n))]
        owner = np.concatenate([k for k, _ in found])
        ids = np.concatenate([i for _, i in found])
        # Ids came from the last to the first: by key, then backwards.
        ids = ids[::-1][np.argsort(owner[::-1], kind="stable")].astype(np.uint32)
        return ids, np.bincount(owner, minlength=len(keys))

    def _abreast(self, keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Steps back along the best paths of rows of equal length: rows, and an id of each."""
        base, check, value, scores = self.tables
        count, n = keys.shape
        columns = np.ascontiguousarray(keys.T).astype(np.int32) + 1
        total = np.full((n + 1, count), -np.inf)
        back, by = np.zeros((n + 1, count), dtype=np.int32), np.zeros((n + 1, count), dtype=np.int32)
        total[0] = 0.0
        lead = keys.T
        widths = 1 + (lead >= 0xC0).astype(np.int32) + (lead >= 0xE0) + (lead >= 0xF0)
        starts = (lead & 0xC0) != 0x80
        for at in range(n):
            rows = np.flatnonzero(starts[at])
            if not len(rows):
                continue
            here, width, single = total[at], widths[at], np.zeros(count, dtype=bool)
            begun, node = rows, np.zeros(len(rows), dtype=np.int32)
            for end in range(at + 1, n + 1):
                child = base[node] + columns[end - 1][rows]
                on = check[child] == node
                rows, node = rows[on], child[on]
                if not len(rows):
                    break
                piece = value[node]
                held = piece >= 0
                ends, piece = rows[held], piece[held]
                single[ends] |= width[ends] == end - at
                score = here[ends] + scores[piece]
                better = score > total[end][ends]
                ends = ends[better]
                total[end][ends], back[end][ends], by[end][ends] = score[better], end - at, piece[better]
            alone = begun[~single[begun]]
            after = at + width[alone]
            score = here[alone] + self.fallback
            better = score > total[after, alone]
            alone, after = alone[better], after[better]
            total[after, alone], back[after, alone], by[after, alone] = score[better], width[alone], -1
        every, end, bytes_of = np.arange(count), np.full(count, n), np.array(self.byte_ids, dtype=np.int64)
        while len(every):
            step, piece = back[end, every], by[end, every]
            whole = piece >= 0
            yield every[whole], piece[whole]
            odd, last, width = every[~whole], end[~whole], step[~whole]
            for i in range(4):
                more = width > i
                yield odd[more], bytes_of[keys[odd[more], last[more] - 1 - i]]
            end = end - step
            every, end = every[end > 0], end[end > 0]

    def best(self, key: bytes) -> array:
        """The ids of the path with the highest sum of scores.

        A character that no piece starts with its own length for can go as bytes, at the
        fallback score. Of equal paths the one whose last differing piece begins earliest
        wins, so the result does not depend on the order of the vocabulary.
        """
        n, scores, fallback, width_of = len(key), self.scores, self.fallback, self.longest + 1
        # Scores lie in a ring as long as the longest piece; each place keeps how it was reached.
        ring = [-math.inf] * width_of
        back, by = array("H", bytes(2 * (n + 1))), array("i", bytes(4 * (n + 1)))
        ring[0], at = 0.0, 0
        while at < n:
            lead = key[at]
            width = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            here, single = ring[at % width_of], False
            ring[at % width_of] = -math.inf
            for end, piece in self.trie.matches(key, at):
                single |= end == at + width
                if (score := here + scores[piece]) > ring[end % width_of]:
                    ring[end % width_of], back[end], by[end] = score, end - at, piece
            after = at + width
            if not single and here + fallback > ring[after % width_of]:
                ring[after % width_of], back[after], by[after] = here + fallback, width, -1
            at = after
        ids, end = array("I"), n
        while end:
            start = end - back[end]
            if by[end] >= 0:
                ids.append(by[end])
            else:
                ids.extend(self.byte_ids[b] for b in reversed(key[start:end]))
            end = start
        ids.reverse()
        return ids


def load_pieces(model: str) -> Pieces:
    """Pieces of a sentencepiece model file.

    Files of merge models order pieces by rank and hold no log probabilities. Zipf's law
    gives them: the piece of rank r has log(1 / (r * H)), H making the sum one.
    """
    import sentencepiece

    file = sentencepiece.SentencePieceProcessor(model_file=model)
    size = file.get_piece_size()
    byte_ids = [file.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    plain = [
        i
        for i in range(size)
        if not (file.is_byte(i) or file.is_control(i) or file.is_unknown(i) or file.is_unused(i))
    ]
    whole = math.log(sum(1 / r for r in range(1, len(plain) + 1)))
    pieces = {file.id_to_piece(i): (i, -math.log(r) - whole) for r, i in enumerate(plain, 1)}
    return Pieces(pieces, byte_ids, size)


class Encoder:
    """Texts to ids. A leading space is added; spaces and the word after them form a unit.

    No piece goes on over the start of a space run or over a line feed, so the best path
    of a text is that of its units, and the units are remembered. Spaces are matched by the
    marker's pieces; a marker character inside a text goes as bytes, so decoding gives
    every text back exactly.
    """

    def __init__(self, pieces: Pieces):
        inner = [p for p in pieces.bytes if p.lstrip(b" ").count(b" ") or p.count(b"\n") and len(p) > 1]
        if inner:
            raise ValueError(f"pieces over the edge of a word: {inner[:3]}")
        self.pieces = pieces
        self.memo = PieceMemo(self._encode)

    def _encode(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return self.pieces.best_of(units)

    def encode(self, texts: list[bytes]) -> list[bytes]:
        filled = [i for i, t in enumerate(texts) if t]
        found = [b""] * len(texts)
        if filled:
            data, limits = laid_out([texts[i] for i in filled], b" ")
            feeds = np.flatnonzero(data == 10)
            cut = data == 32
            cut[1:] &= data[:-1] != 32
            cut[feeds] = cut[limits[:-1]] = True
            cut[np.minimum(feeds + 1, len(data) - 1)] = True
            starts = np.flatnonzero(cut)
            ids, sizes = self.memo.take(data, starts, np.append(starts[1:], len(data)))
            for i, own in zip(filled, by_text(ids, sizes, starts, limits), strict=True):
                found[i] = own.astype("<u4").tobytes()
        return found

    def decode(self, ids: bytes) -> bytes:
        found = np.frombuffer(ids, dtype="<u4").tolist()
        return b"".join(map(self.pieces.bytes.__getitem__, found))[1:]


_ENCODERS: dict[str, Encoder] = {}


def encoder(model: str) -> Encoder:
    """One per worker process."""
    if model not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[model] = Encoder(load_pieces(model))
    return _ENCODERS[model]


def encode(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ids of every row: little-endian unsigned 32-bit numbers in a binary column.

    `model` is a path that executors can read. One narrow stage. Null and empty texts have
    no ids; every input row, repeated ones too, gives one row.
    """
    id_type = docs.schema[doc_id].dataType.simpleString()

    def encoded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = encoder(model)
        for batch in slices(batches, "text", BATCH_BYTES):
            texts = batch.column("text").fill_null("").cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(work.encode(texts), pa.binary())],
                names=["doc_id", "ids"],
            )

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(encoded, f"doc_id {id_type}, ids binary")


def decode(encoded: DataFrame, model: str, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns and the text that the ids stand for; a null has an empty text."""
    fields = {f.name: f.dataType.simpleString() for f in encoded.schema}

    def decoded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = encoder(model)
        for batch in slices(batches, "ids", BATCH_BYTES):
            texts = [work.decode(i or b"") for i in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in carry], pa.array(texts, pa.binary()).cast(pa.string())],
                names=[*carry, "text"],
            )

    kept = list(dict.fromkeys([*carry, "ids"]))
    schema = ", ".join(f"`{c}` {fields[c]}" for c in carry) + ", text string"
    return encoded.select(*kept).mapInArrow(decoded, schema)


def piece_counts(spark: SparkSession, docs: DataFrame, model: str) -> DataFrame:
    """Per row: how many pieces, a checksum of the ids, and a digest of the decoded text."""
    encoded = encode(docs, model)
    return decode(encoded, model, ("doc_id", "ids")).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_pieces"),
        F.crc32("ids").alias("ids_crc32"),
        F.octet_length("text").cast("long").alias("decoded_bytes"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )
