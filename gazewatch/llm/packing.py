"""Lexical packing: documents that share rare tokens fill the same training window."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazewatch.llm.common import checkpoint_folder, partitions, slices
from gazewatch.llm.memo import PieceMemo, by_text, laid_out, white_space

WINDOW = 1024
END_ID = 0
#: Unknown pieces that go to the library as one text.
JOINED = 500
BATCH_BYTES = 500_000
#: A shard of the index holds about so many tokens or documents; beyond SLACK times as many
#: a further index begins.
SHARD_TOKENS = 1_500_000
SHARD_DOCS = 2_048
SLACK = 1.5
#: Documents sampled for each shard to find where shards begin, and in all at most.
SAMPLED, MOST_SAMPLED = 64, 1_000_000
#: A document is dealt by so many of its rarest terms.
DEALT_BY = 3
#: A term in more than this share of a shard's documents is scored for all seeds at once.
OFTEN = 1 / 8
K1, B = 1.2, 0.75


_SIGNS, _LETTERS = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_SIGNS[list(b".,;:!?()\"#$%&*+-/=@[\\]^_`{}~")] = True
_LETTERS[[c for c in range(128) if chr(c).isalnum()]] = True


class ByteEncoder:
    """Ids of texts by a byte-level vocabulary file, as its library gives them.

    The vocabulary's pattern never joins a character with white space that follows it, and
    it gives a single space to the word after it. So a text falls into pieces before each
    single space and around each single line feed, with no white space on either side, and
    between a letter and a sign.
    Each distinct piece is encoded by the library once and remembered.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.special]
        self.mark, self.mark_id = special[0], self.tokenizer.token_to_id(special[0])
        if any(_SIGNS[list("".join(special).encode())]):
            raise ValueError("a special string holds a sign at which texts are cut")
        self.memo = PieceMemo(self._encode)

    def _encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The library gets pieces in order, as those that begin alike share their merges."""
        order = np.array(sorted(range(len(pieces)), key=pieces.__getitem__))
        ids, sizes = self._encode_ordered([pieces[i] for i in order.tolist()])
        begins, place = np.cumsum(sizes) - sizes, np.argsort(order)
        begins, sizes = begins[place], sizes[place]
        return ids[np.repeat(begins - np.cumsum(sizes) + sizes, sizes) + np.arange(len(ids))], sizes

    def _encode_ordered(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Many pieces go to the library as one text with its special string between them,
        which it never joins with anything, or one by one where a piece has that string itself."""
        texts = [p.decode() for p in pieces]
        whole = [t for t in texts if self.mark not in t]
        if len(whole) < len(texts):
            found = self._ids(texts)
            return np.concatenate(found), np.array([len(ids) for ids in found], dtype=np.int64)
        joined = [self.mark.join(whole[i : i + JOINED]) for i in range(0, len(whole), JOINED)]
        ids = np.concatenate([np.append(ids, np.uint32(self.mark_id)) for ids in self._ids(joined)])
        marks = np.flatnonzero(ids == self.mark_id)
        return ids[ids != self.mark_id], np.diff(np.concatenate(([-1], marks))) - 1

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype=np.uint32) for e in found]

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        data, limits = laid_out(texts)
        if not len(data):
            return [np.zeros(0, dtype=np.uint32) for _ in texts]
        white = white_space(data) | ((data >= 28) & (data <= 31))
        alone = np.zeros(len(data), dtype=bool)
        alone[1:-1] = ~white[:-2] & ~white[2:]
        edges = limits[(limits > 0) & (limits < len(data))]
        alone[edges] = alone[edges - 1] = False
        feeds = np.flatnonzero(alone & (data == 10))
        cut = np.zeros(len(data), dtype=bool)
        cut[alone & (data == 32)] = cut[feeds] = cut[feeds + 1] = True
        # A sign right after a letter or digit begins a new word of the pattern.
        cut[1:] |= _SIGNS[data[1:]] & _LETTERS[data[:-1]]
        cut[limits[:-1][limits[:-1] < len(data)]] = True
        starts = np.flatnonzero(cut)
        ids, sizes = self.memo.take(data, starts, np.append(starts[1:], len(data)))
        return by_text(ids, sizes, starts, limits)


_ENCODERS: dict[str, ByteEncoder] = {}


def byte_encoder(path: str) -> ByteEncoder:
    """One per worker process."""
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = ByteEncoder(path)
    return _ENCODERS[path]


def inverse_frequency(n: int, frequency: np.ndarray) -> np.ndarray:
    return np.log1p((n - frequency + 0.5) / (frequency + 0.5))


class Shard:
    """A BM25 inverted index over token ids of one shard's documents.

    `idf` (by token id) and `mean` length are those of the corpus, else those of the shard.
    """

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray | None = None, mean: float | None = None):
        n = len(docs)
        lengths = np.array([len(d) for d in docs], dtype=np.int64)
        owner = np.repeat(np.arange(n, dtype=np.int64), lengths)
        keys = np.sort((np.concatenate(docs).astype(np.int64) << 24) | owner)
        new = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        times = np.diff(np.append(new, len(keys)))
        keys = keys[new]
        terms, self.doc = keys >> 24, keys & 0xFFFFFF
        starts = np.flatnonzero(np.concatenate(([True], terms[1:] != terms[:-1])))
        ends = np.append(starts[1:], len(keys))
        self.ends, self.starts, self.n = ends, starts, n
        frequency = ends - starts
        idf = inverse_frequency(n, frequency) if idf is None else idf[terms[starts]]
        norm = K1 * (1 - B + B * lengths / max(1.0, lengths.mean() if mean is None else mean))
        term = np.repeat(np.arange(len(starts)), frequency)
        self.weight = idf[term] * times * (K1 + 1) / (times + norm[self.doc])
        # Frequent terms make one product of all queries with all documents; the postings
        # of the others are added up seed by seed. A document's query is all its terms.
        often = np.flatnonzero(frequency > OFTEN * n)
        column = np.full(len(starts), -1)
        column[often] = np.arange(len(often))
        heavy = np.flatnonzero(column[term] >= 0)
        asked, weights = np.zeros((n, len(often))), np.zeros((len(often), n))
        asked[self.doc[heavy], column[term[heavy]]] = 1
        weights[column[term[heavy]], self.doc[heavy]] = self.weight[heavy]
        self.frequent = asked @ weights
        shared = np.flatnonzero((frequency[term] > 1) & (column[term] < 0))
        order = shared[np.argsort(self.doc[shared], kind="stable")]
        self.query_terms = term[order]
        self.query_starts = np.searchsorted(self.doc[order], np.arange(n + 1))

    def scores(self, seed: int, unused: np.ndarray) -> np.ndarray:
        """BM25 over all terms of the seed, and 0 for used documents; rounded, so that equal
        documents are equal however their terms were added up."""
        terms = self.query_terms[self.query_starts[seed] : self.query_starts[seed + 1]]
        scores = self.frequent[seed]
        if len(terms):
            sizes = self.ends[terms] - self.starts[terms]
            places = np.repeat(self.starts[terms] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            scores = scores + np.bincount(self.doc[places], self.weight[places], minlength=self.n)
        return np.round(scores * unused, 9)

    def neighbours(self, seed: int, unused: np.ndarray) -> np.ndarray:
        """Unused documents that share a term with the seed, the best first."""
        scores = self.scores(seed, unused)
        found = np.flatnonzero(scores)
        return found[np.lexsort((found, -scores[found]))]

    def ranked(self, seed: int, unused: np.ndarray) -> Iterator[int]:
        """The same one by one; mostly few are taken."""
        scores = self.scores(seed, unused)
        while scores[best := int(np.argmax(scores))] > 0:
            scores[best] = 0
            yield best


def pack_shard(
    docs: list[np.ndarray], window: int, idf: np.ndarray | None = None, mean: float | None = None
) -> Iterator[list[tuple[int, int, int]]]:
    """Sequences as lists of (document, start, length) that hold each id exactly once.

    Whole windows of a document stand alone. Its rest is a seed, or fills a seed's window
    as a neighbour; the neighbour that does not fit is cut, and what is left of it is the
    next seed. Neighbours are told by all ids of the documents, not by those of their rests.
    The last rest is written in sequences of power-of-two lengths.
    """
    rest = np.array([len(d) % window for d in docs])
    for i, d in enumerate(docs):
        for start in range(0, len(d) - window + 1, window):
            yield [(i, start, window)]
    tails = np.flatnonzero(rest)
    if not len(tails):
        return
    index = Shard([docs[i] for i in tails], idf, mean)
    unused, begin = np.ones(len(tails), dtype=bool), [len(docs[i]) - rest[i] for i in tails]
    left = [int(rest[i]) for i in tails]
    seed, order, turn = 0, iter(range(len(tails))), []
    while True:
        if seed is None:
            seed = next((i for i in order if unused[i]), None)
            if seed is None:
                return
        unused[seed] = False
        turn, free = [(int(tails[seed]), int(begin[seed]), left[seed])], window - left[seed]
        ranked, seed_of_next = index.ranked(seed, unused), None
        while free:
            near = next(ranked, None)
            if near is None:
                near = next((i for i in order if unused[i]), None)
                if near is None:
                    break
            if not unused[near]:
                continue
            unused[near] = False
            taken = min(free, left[near])
            turn.append((int(tails[near]), int(begin[near]), taken))
            begin[near] += taken
            left[near] -= taken
            free -= taken
            if left[near]:
                seed_of_next = near
        if free and free != window:
            yield from powers(turn)
        else:
            yield turn
        seed = seed_of_next


def powers(pieces: list[tuple[int, int, int]]) -> Iterator[list[tuple[int, int, int]]]:
    """The same ids in sequences whose lengths are powers of two, the longest first."""
    total = sum(length for _, _, length in pieces)
    pieces = [list(p) for p in pieces]
    for bit in range(total.bit_length() - 1, -1, -1):
        need, turn = total & (1 << bit), []
        while need:
            doc, start, length = pieces[0]
            taken = min(need, length)
            turn.append((doc, start, taken))
            need -= taken
            if taken == length:
                pieces.pop(0)
            else:
                pieces[0] = [doc, start + taken, length - taken]
        if turn:
            yield turn


def encoded(docs: DataFrame, vocabulary: str, doc_id: str, text: str) -> DataFrame:
    """row, doc_id, n_tokens and ids of every row, in 2 bytes an id where the vocabulary allows."""
    id_type = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = byte_encoder(vocabulary)
        kind = "<u2" if work.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        row = TaskContext.get().partitionId() << 33
        for batch in slices(batches, "text", BATCH_BYTES):
            found = work.encode(batch.column("text").fill_null("").cast(pa.binary()).to_pylist())
            rows = pa.array(range(row, row + len(found)), pa.int64())
            row += len(found)
            sizes = pa.array([len(ids) + 1 for ids in found], pa.int64())
            ids = pa.array([np.append(ids, END_ID).astype(kind).tobytes() for ids in found], pa.binary())
            yield pa.RecordBatch.from_arrays([rows, batch.column("doc_id"), sizes, ids], names=["row", "doc_id", "n_tokens", "ids"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"row long, doc_id {id_type}, n_tokens long, ids binary")


def _ids(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The ids of a batch's rows, one after the other, and how many each has."""
    sizes = batch.column("n_tokens").to_numpy()
    whole = b"".join(batch.column("ids").to_pylist())
    return np.frombuffer(whole, dtype=f"<u{len(whole) // max(1, int(sizes.sum()))}"), sizes


def document_frequencies(docs: DataFrame) -> tuple[int, int, np.ndarray]:
    """Over all encoded rows: how many, how many tokens, and in how many rows each id is.

    Each task counts first; one sum for each id of the vocabulary reaches the driver.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, tokens, held = 0, 0, np.zeros(0, dtype=np.int64)
        for batch in slices(batches, "ids", BATCH_BYTES):
            ids, sizes = _ids(batch)
            keys = np.sort(np.repeat(np.arange(len(sizes), dtype=np.uint64) << np.uint64(32), sizes) | ids)
            own = keys[np.concatenate(([True], keys[1:] != keys[:-1]))] & np.uint64(0xFFFFFFFF)
            counts = np.bincount(own.astype(np.int64), minlength=len(held))
            counts[: len(held)] += held
            n, tokens, held = n + len(sizes), tokens + int(sizes.sum()), counts
        terms = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(terms, [-1, -2])), pa.array(np.append(held[terms], [n, tokens]))], names=["term", "n"]
        )

    counts = docs.select("n_tokens", "ids").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    found = {r["term"]: r["n"] for r in counts.collect()}
    n, tokens = found.pop(-1, 0), found.pop(-2, 0)
    frequency = np.zeros(max(found, default=0) + 1, dtype=np.int64)
    frequency[list(found)] = list(found.values())
    return n, tokens, frequency


def places(batch: pa.RecordBatch, rank: np.ndarray) -> np.ndarray:
    """Where rows stand in the order of their rarest shared terms, and by chance among equals.

    `rank` has the rank of each id, the rarest first, and len(rank) for ids of one row only.
    """
    ids, sizes = _ids(batch)
    bits, starts = len(rank).bit_length(), np.cumsum(sizes) - sizes
    ranks, place = rank[ids], np.zeros(len(sizes), dtype=np.int64)
    for _ in range(DEALT_BY):
        least = np.minimum.reduceat(ranks, starts)
        place = (place << bits) | least
        ranks[ranks == np.repeat(least, sizes)] = len(rank)
    chance = 63 - DEALT_BY * bits
    row = batch.column("row").to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (place << chance) | (row >> np.uint64(64 - chance)).astype(np.int64)


def shard_limits(docs: DataFrame, n: int, tokens: int, rank: np.ndarray) -> np.ndarray:
    """The places at which shards after the first begin, from a sample of bounded size."""
    shards = max(1, -(-n // SHARD_DOCS), -(-tokens // SHARD_TOKENS))
    share = min(1.0, min(SAMPLED * shards, MOST_SAMPLED) / max(1, n))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "ids", BATCH_BYTES):
            yield pa.RecordBatch.from_arrays([pa.array(places(batch, rank)), batch.column("n_tokens")], names=["place", "n"])

    rows = docs.select("row", "n_tokens", "ids")
    rows = rows.sample(share, seed=1) if share < 1 else rows
    found = sorted((r["place"], r["n"]) for r in rows.mapInArrow(run, "place long, n long").collect())
    weight = np.cumsum([max(1 / SHARD_DOCS, size / SHARD_TOKENS) for _, size in found])
    if not len(found):
        return np.zeros(0, dtype=np.int64)
    # The sample's weight, spread over as many shards as the whole has room for.
    shards = max(1, round(float(weight[-1]) / share + 0.5))
    cuts = np.searchsorted(weight, weight[-1] * np.arange(1, shards) / shards)
    return np.unique(np.array([place for place, _ in found], dtype=np.int64)[cuts])


def pack(docs: DataFrame, vocabulary: str, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of token sequences: doc_id, start, length, ids, doc_tokens, sequence_id, offset.

    A document's ids are those of its text (null: none) and a closing id 0. `ids` holds a
    piece's ids as little-endian unsigned 32-bit numbers. Texts are encoded once and their
    ids written to the shared folder. Document frequencies and mean length are those of all
    rows. Rows are ordered by their rarest terms that some other row has too, and shards are
    runs of that order, so rows of one content meet wherever they were stored; equal rows
    are told apart by chance, and many of them are just more shards. Sequences never cross
    shards; sequence_id is the shard's number times 2**33 plus a count. Rows with null or
    repeated ids are packed like all others.
    """
    spark = docs.sparkSession
    path = f"{checkpoint_folder(spark)}/packing-{uuid.uuid4()}"
    encoded(docs, vocabulary, doc_id, text).write.option("compression", "zstd").parquet(path)
    staged = spark.read.parquet(path)
    n, tokens, frequency = document_frequencies(staged)
    idf, mean = inverse_frequency(n, frequency), tokens / max(1, n)
    shared = np.flatnonzero(frequency > 1)
    rank = np.full(len(frequency), len(frequency), dtype=np.int64)
    rank[shared[np.argsort(frequency[shared], kind="stable")]] = np.arange(len(shared))
    limits = shard_limits(staged, n, tokens, rank)

    def dealt(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "ids", BATCH_BYTES):
            place = places(batch, rank)
            shard = pa.array(np.searchsorted(limits, place, side="right"))
            columns = [shard, pa.array(place), *batch.columns]
            yield pa.RecordBatch.from_arrays(columns, names=["shard", "place", *batch.schema.names])

    id_type = docs.schema[doc_id].dataType.simpleString()
    rows = staged.select("row", "doc_id", "n_tokens", "ids")
    rows = rows.mapInArrow(dealt, f"shard long, place long, row long, doc_id {id_type}, n_tokens long, ids binary")
    rows = rows.repartition(partitions(spark), "shard").sortWithinPartitions("shard", "place", "row")
    schema = f"doc_id {id_type}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

    def packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, owners, tokens, shard, number = [], [], 0, None, 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, owners, tokens, number
            rows, size = [], 0
            for sequence in pack_shard(held, window, idf, mean):
                offset = 0
                for doc, start, length in sequence:
                    ids = held[doc][start : start + length].astype("<u4").tobytes()
                    rows.append((owners[doc], start, length, ids, len(held[doc]), number, offset))
                    offset += length
                    size += length
                number += 1
                if size > SHARD_TOKENS // 4:
                    yield to_batch(rows)
                    rows, size = [], 0
            if rows:
                yield to_batch(rows)
            held, owners, tokens = [], [], 0

        def to_batch(rows: list[tuple]) -> pa.RecordBatch:
            long, columns = pa.int64(), list(zip(*rows, strict=True))
            kinds = [id_kind, long, long, pa.binary(), long, long, long]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        id_kind = None
        for batch in slices(batches, "ids", BATCH_BYTES):
            id_kind = batch.schema.field("doc_id").type
            ids, sizes = _ids(batch)
            own = np.split(ids, np.cumsum(sizes)[:-1])
            for at, owner, doc in zip(batch.column("shard").to_pylist(), batch.column("doc_id").to_pylist(), own, strict=True):
                full = tokens >= SLACK * SHARD_TOKENS or len(held) >= SLACK * SHARD_DOCS
                if held and (at != shard or full):
                    yield from flush()
                if at != shard:
                    shard, number = at, at << 33
                held.append(doc.astype(np.uint32))
                owners.append(owner)
                tokens += len(doc)
        if held:
            yield from flush()

    return rows.select("shard", "doc_id", "n_tokens", "ids").mapInArrow(packed, schema)
