"""Near-duplicate classes by MinHash bands, odd sketches and exact confirmation.

Documents with the same set of shingles collapse to one node first. MinHash samples are
banded: documents that agree in a whole band are candidates. An odd sketch folds the same
samples into a parity bitmap; the number of ones in the XOR of two sketches tells how many
samples differ, which sorts out most candidates. An odd sketch of the whole set, some bits
for each shingle, then bounds the difference of the sets from below and sorts out nearly all
that are not similar enough. The rest are confirmed on their full sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazewatch.llm.common import checkpointed, partitions, slices
from gazewatch.llm.hashing import Prefixes, Words, mixed

SHINGLE = 3
#: Samples of a band, and how rarely a similar enough pair may agree in no band at all.
ROWS, MISSED = 5, 1e-8
SKETCH_BITS = 1024
#: Standard deviations that a true pair's sketches may lie beyond what is expected.
SLACK = 5.0
#: Members of a bucket that one task compares with as many others.
TILE = 512
CHUNK_BYTES = 250_000


def band_count(percent: int) -> int:
    """So many bands that a pair of just this similarity is missed once in 10**8 pairs."""
    return math.ceil(math.log(MISSED) / math.log(1 - min(percent / 100, 0.999) ** ROWS))


def samplers(bands: int) -> np.ndarray:
    """Multiplier and summand of each sample's hash function, the same in every process."""
    drawn = np.random.default_rng(7).integers(0, 1 << 63, (bands * ROWS, 2), dtype=np.uint64)
    return drawn * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text, as hashes one after the other, and where each text's begin.

    A text of fewer words than a shingle has its whole sequence as one.
    """
    words = Words(texts, fold=True)
    runs = Prefixes(words.hashes)
    starts = np.flatnonzero(words.fits(width))
    counts = np.diff(words.first)
    short = np.flatnonzero((counts > 0) & (counts < width))
    owner = np.concatenate((words.owner[starts], short))
    hashes = np.concatenate(
        (runs.runs(starts, starts + width), runs.runs(words.first[short], words.first[short + 1]))
    )
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    owner, hashes = owner[new], hashes[new]
    return hashes, np.searchsorted(owner, np.arange(len(texts) + 1))


def set_sketches(hashes: np.ndarray, limits: np.ndarray) -> list[bytes]:
    """An odd sketch of each whole set: four to eight bits for each shingle, at least 64."""
    found = []
    for a, b in zip(limits[:-1].tolist(), limits[1:].tolist(), strict=True):
        bits = max(64, 1 << (4 * (b - a) - 1).bit_length()) if b > a else 64
        at = (hashes[a:b] & np.uint64(bits - 1)).astype(np.int64)
        parity = np.bincount(at, minlength=bits).astype(np.uint8) & 1
        found.append(np.packbits(parity).tobytes())
    return found


def folded(sketch: np.ndarray, words: int) -> np.ndarray:
    """Sketches (one in a row) with fewer bits: halves that fall on each other cancel."""
    while sketch.shape[1] > words:
        half = sketch.shape[1] // 2
        sketch = sketch[:, :half] ^ sketch[:, half:]
    return sketch


def signatures(docs: DataFrame, width: int, bands: int, doc_id: str, text: str) -> DataFrame:
    """doc_id, n_shingles, a 128-bit digest of the set, band keys and odd sketches of every row."""
    id_type = docs.schema[doc_id].dataType.simpleString()
    functions, samples = samplers(bands), bands * ROWS

    def signed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", CHUNK_BYTES):
            texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            hashes, limits = shingle_sets(texts, width)
            sizes = np.diff(limits)
            some = np.flatnonzero(sizes)
            columns = [np.zeros(len(texts), dtype=np.int64) for _ in range(2)]
            keys = np.zeros((len(texts), bands), dtype=np.int64)
            sketch = np.zeros((len(texts), SKETCH_BITS // 64), dtype=np.int64)
            if len(some):
                at = limits[:-1][some]
                columns[0][some] = np.add.reduceat(hashes, at).view(np.int64)
                columns[1][some] = np.add.reduceat(mixed(hashes ^ np.uint64(0xA5A5A5A5A5A5)), at).view(np.int64)
                least = np.stack([np.minimum.reduceat(hashes * a + b, at) for a, b in functions], axis=1)
                seeds = np.arange(samples, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                least = mixed(least + seeds)
                key = np.zeros((len(some), bands), dtype=np.uint64)
                for r in range(ROWS):
                    key = mixed(key + least[:, r::ROWS])
                keys[some] = key.view(np.int64)
                bits = (least % np.uint64(SKETCH_BITS)).astype(np.int64)
                flat = (np.arange(len(some))[:, None] * SKETCH_BITS + bits).ravel()
                parity = np.bincount(flat, minlength=len(some) * SKETCH_BITS).astype(np.uint8) & 1
                sketch[some] = np.packbits(parity.reshape(len(some), -1), axis=1).view(np.int64)
            lists = lambda m: pa.ListArray.from_arrays(
                pa.array(np.arange(len(m) + 1) * m.shape[1], pa.int32()), pa.array(m.ravel())
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes.astype(np.int64)), *map(pa.array, columns),
                 lists(keys), lists(sketch), pa.array(set_sketches(hashes, limits), pa.binary())],
                names=["doc_id", "n_shingles", "d1", "d2", "bands", "sketch", "whole"],
            )

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(
        signed, f"doc_id {id_type}, n_shingles long, d1 long, d2 long, bands array<long>, sketch array<long>, whole binary"
    )


def most_ones(similarity: float) -> int:
    """How many ones the XOR of the odd sketches of a similar enough pair can have.

    Of the samples, a binomial number differs; each puts two places into the XOR, where
    equal places cancel. Both spreads are allowed for.
    """
    samples = band_count(round(100 * similarity)) * ROWS
    differing = samples * (1 - similarity) + SLACK * math.sqrt(samples * similarity * (1 - similarity))
    expected = SKETCH_BITS / 2 * (1 - (1 - 2 / SKETCH_BITS) ** (2 * differing))
    return math.ceil(expected + SLACK * math.sqrt(2 * differing**2 / SKETCH_BITS) + 2)


class Members:
    """Sizes and sketches of some sets, to be compared one with many."""

    def __init__(self, n: np.ndarray, sketch: np.ndarray, whole: list[bytes], percent: int):
        self.n, self.sketch, self.percent, self.limit = n, sketch, percent, most_ones(percent / 100)
        self.words = np.array([len(w) // 8 for w in whole], dtype=np.int64)
        self.row = np.zeros(len(n), dtype=np.int64)
        self.whole = {}
        for words in np.unique(self.words).tolist():
            own = np.flatnonzero(self.words == words)
            self.row[own] = np.arange(len(own))
            joined = b"".join([whole[i] for i in own.tolist()])
            self.whole[words] = np.frombuffer(joined, dtype=np.uint64).reshape(len(own), words)

    def may_link(self, x: int, y: np.ndarray) -> np.ndarray:
        """Those of y whose sizes and sketches let them be similar enough to x.

        The set sketches differ in at most as many places as the sets, and of similar
        enough sets d * (100 + percent) <= (n_x + n_y) * (100 - percent) elements differ.
        """
        n, share = self.n, self.percent
        y = y[100 * np.minimum(n[y], n[x]) >= share * np.maximum(n[y], n[x])]
        y = y[np.bitwise_count(self.sketch[y] ^ self.sketch[x]).sum(axis=1) <= self.limit]
        kept = []
        for words in np.unique(self.words[y]).tolist():
            some = y[self.words[y] == words]
            least = min(words, int(self.words[x]))
            own = folded(self.whole[int(self.words[x])][self.row[x]][None, :], least)
            others = folded(self.whole[words][self.row[some]], least)
            ones = np.bitwise_count(own ^ others).sum(axis=1).astype(np.int64)
            kept.append(some[ones * (100 + share) <= (n[some] + n[x]) * (100 - share)])
        return np.concatenate(kept) if kept else y[:0]


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(len(column), -1)


def _sift(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose set sizes and sketches let them be similar enough."""
    names = ("n", "sketch", "whole")
    side = lambda s: nodes.select(F.col("node").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in names])

    def sift(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            both = lambda c: (batch.column(f"{c}_a"), batch.column(f"{c}_b"))
            k = batch.num_rows
            members = Members(
                np.concatenate([c.to_numpy() for c in both("n")]),
                np.concatenate([_matrix(c) for c in both("sketch")]),
                [w for c in both("whole") for w in c.to_pylist()],
                percent,
            )
            kept = [len(members.may_link(i, np.array([k + i]))) > 0 for i in range(k)]
            yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    met = pairs.join(side("a"), "a").join(side("b"), "b")
    columns = ["a", "b", *[f"{c}_{s}" for s in "ab" for c in names]]
    return met.select(*columns).mapInArrow(sift, "a long, b long")


def _confirm(pairs: DataFrame, docs: DataFrame, width: int, percent: int, doc_id: str, text: str) -> DataFrame:
    """The pairs with 100 * |intersection| >= percent * |union| on their full sets."""
    wanted = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()

    def with_sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", CHUNK_BYTES):
            texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            hashes, limits = shingle_sets(texts, width)
            sets = [hashes[a:b].tobytes() for a, b in zip(limits[:-1], limits[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").cast(pa.int64()), pa.array(sets, pa.binary())], names=["id", "shingles"]
            )

    def linked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "set_a", CHUNK_BYTES):
            kept = []
            for x, y in zip(batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist(), strict=True):
                both = np.concatenate((np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)))
                union = len(np.unique(both))
                kept.append(100 * (len(both) - union) >= percent * union)
            yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    texts = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    sets = texts.join(wanted, "id", "left_semi").mapInArrow(with_sets, "id long, shingles binary")
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("set_a"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("set_b"))
    met = pairs.join(right, "b").join(left, "a")
    return met.select("a", "b", "set_a", "set_b").mapInArrow(linked, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """node and root, the smallest node that links (a, b) lead to; nodes without links are left out.

    Alternating stars: every node hands its larger neighbours, then its smaller ones, to the
    least it knows. The edges end as stars around roots after about log n rounds. Hubs are
    only ever aggregated by minimum and joined, and every round is checkpointed.
    """
    edges = checkpointed(
        links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    state = None
    while True:
        summed = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(summed) == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = tuple(summed)
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u != v")
        )
        edges = checkpointed(small.distinct())


def _cross_pairs(rows: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components in one bucket whose sizes and sketches agree.

    `rows` has key, node and root. A bucket of any size is cut into tiles of members; every
    two tiles meet in one group, which holds two tiles at most. Only pairs that pass the
    bound of the set sketches come out, and these are nearly all similar enough.
    """
    sizes = rows.groupBy("key").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    own = F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")
    dealt = (
        rows.join(sizes, "key")
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "root")
        .join(nodes.select("node", "n", "sketch", "whole"), "node")
        # By tiles, not by key alone, so that a large bucket is many tasks' work.
        .repartition(partitions(rows.sparkSession), "key", "i", "j")
    )

    def compare(group: pa.Table) -> pa.Table:
        node, root, own, n = [group.column(c).to_numpy() for c in ("node", "root", "own", "n")]
        i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
        members = Members(n, _matrix(group.column("sketch")), group.column("whole").to_pylist(), percent)
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        found = [np.zeros((0, 2), dtype=np.int64)]
        for x in left.tolist():
            y = right[(root[right] != root[x]) & ((node[right] > node[x]) | (i != j))]
            y = members.may_link(x, y) if len(y) else y
            if len(y):
                found.append(np.stack((np.full(len(y), node[x]), node[y]), axis=1))
        pairs = np.sort(np.concatenate(found), axis=1)
        return pa.table({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})

    return dealt.groupBy("key", "i", "j").applyInArrow(compare, "a long, b long").distinct()


def near_duplicates(
    docs: DataFrame, percent: int = 85, width: int = SHINGLE, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row.

    Rows link if their sets of `width`-word shingles (words at blanks, A-Z lower-cased) have
    100 * |intersection| >= percent * |union|; component_id is the smallest doc_id that links
    reach. Texts without words have no set and link with nothing. doc_id is an integer: rows
    that share one are one node; a row without one links with nothing, has a null
    component_id and is kept. The number of bands follows from percent.

    Every bucket first compares its members with its smallest one, which is linear. Only
    members that then still are in different components of a bucket are compared with each
    other, by sketches in tiles, so no link is lost and none but these pairs are made.
    """
    signed = checkpointed(signatures(docs, width, band_count(percent), doc_id, text))
    valid = signed.where("n_shingles > 0 AND doc_id IS NOT NULL").withColumn("node", F.col("doc_id").cast("long"))
    classes = checkpointed(valid.groupBy("d1", "d2").agg(F.min("node").alias("node")))
    nodes = valid.join(classes, ["d1", "d2", "node"], "left_semi")
    nodes = nodes.select("node", F.col("n_shingles").alias("n"), "sketch", "whole", "bands")
    buckets = nodes.select("node", F.explode("bands").alias("key"))
    leaders = buckets.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("last")).where("a < last")
    # What is left are buckets of several nodes; the sketches wait until they are needed.
    shared = checkpointed(buckets.join(leaders.select("key", "a"), "key").select("key", "node", "a"))
    stars = shared.where("node != a").select("a", F.col("node").alias("b"))
    # Rows of one doc_id with different texts are one node.
    same = valid.groupBy("node").agg(F.count("*").alias("rows")).where("rows > 1").select("node")
    same = valid.join(same, "node", "left_semi")
    same = same.select("d1", "d2", F.col("node").alias("b")).join(classes, ["d1", "d2"]).select(F.col("node").alias("a"), "b")
    tested = checkpointed(_sift(stars.distinct(), nodes, percent))
    links = checkpointed(_confirm(tested, docs, width, percent, doc_id, text).union(same.where("a != b")))
    first = components(links)
    placed = shared.join(first, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    placed = checkpointed(placed)
    open_keys = placed.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x < y")
    crossing = _cross_pairs(placed.join(open_keys.select("key"), "key"), nodes, percent)
    untested = checkpointed(crossing.join(tested, ["a", "b"], "left_anti"))
    more = _confirm(untested, docs, width, percent, doc_id, text)
    roots = components(links.union(more))
    by_class = classes.join(roots, "node", "left").select(
        "d1", "d2", F.coalesce("root", "node").alias("component_id")
    )
    joined = signed.join(by_class, ["d1", "d2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id").cast("long"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return joined.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )
