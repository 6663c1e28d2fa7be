"""Substring, suffix-array and near-duplicate removal against brute force."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pytest
from hard_rows import docs, no_docs, rows  # noqa: F401  fixtures

from gazewatch.llm import near_dedup, suffix_dedup, window_dedup


def covered(items, length, repeated):
    gone = [False] * len(items)
    for i in range(len(items) - length + 1):
        if repeated(tuple(items[i : i + length])):
            gone[i : i + length] = [True] * length
    return gone


@pytest.mark.parametrize("window", [7, 12, 35])
def test_windows(docs, rows, window):
    split = [(t or "").encode().split() for _, t in rows]
    count = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    want = []
    for (doc_id, _), words in zip(rows, split, strict=True):
        gone = covered(words, window, lambda w: count[w] > 1)
        kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g).decode()
        want.append((str(doc_id), kept, len(words), sum(gone)))
    got = [(str(r[0]), *r[1:]) for r in window_dedup.remove_repeats(docs, window).collect()]
    assert sorted(got) == sorted(want)
    assert any(w[3] for w in want)


def test_covers_hold_every_difference():
    for period, cover in window_dedup.COVERS.items():
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))


def test_no_rows(no_docs):
    assert window_dedup.remove_repeats(no_docs).count() == 0
    assert suffix_dedup.remove_repeats(no_docs).count() == 0
    assert near_dedup.near_duplicates(no_docs).count() == 0


@pytest.mark.parametrize("hot", [4096, 2, 0])
@pytest.mark.parametrize("length,k", [(24, 8), (50, 16)])
def test_strings(docs, rows, length, k, hot):
    data = [(t or "").encode() for _, t in rows]
    count = Counter(tuple(d[i : i + length]) for d in data for i in range(len(d) - length + 1))
    want = []
    for (doc_id, _), d in zip(rows, data, strict=True):
        gone = covered(d, length, lambda s: count[s] > 1)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        want.append((str(doc_id), kept, len(d), sum(gone), spans))
    got = suffix_dedup.remove_repeats(docs, length, k=k, hot_segments=hot).collect()
    assert sorted((str(r[0]), bytes(r[1]), *r[2:]) for r in got) == sorted(want)


@pytest.mark.parametrize("hot", [4096, 2])
def test_first_copies_stay(spark, rows, hot):
    length, numbered = 24, [(i, t) for i, (_, t) in enumerate(rows)]
    seen: set = set()
    want = []
    for doc_id, t in numbered:
        d, gone = (t or "").encode(), None
        gone = [False] * len(d)
        for i in range(len(d) - length + 1):
            if d[i : i + length] in seen:
                gone[i : i + length] = [True] * length
            seen.add(d[i : i + length])
        want.append((doc_id, bytes(b for b, g in zip(d, gone, strict=True) if not g)))
    df = spark.createDataFrame(numbered, "doc_id long, text string").repartition(3)
    got = suffix_dedup.remove_repeats(df, length, keep_first=True, k=8, hot_segments=hot).collect()
    assert sorted((r[0], bytes(r[1])) for r in got) == want


def test_removed_stretches_end_at_characters(docs):
    for r in suffix_dedup.remove_repeats(docs, 24, whole_chars=True, k=8).collect():
        bytes(r.kept).decode()


def test_long_texts_are_cut_into_parts(spark, monkeypatch):
    text = " ".join(f"{i:05d}" for i in range(600))
    df = spark.createDataFrame([(1, text), (2, text[1000:1500])], "doc_id long, text string")
    monkeypatch.setattr(suffix_dedup, "PART", 700)
    got = {r.doc_id: r.n_removed for r in suffix_dedup.remove_repeats(df, 200).collect()}
    assert got == {1: 500, 2: 500}


@pytest.mark.parametrize("length", [8, 20, 100, 200])
def test_suffix_order_and_previous_factors(length):
    data = np.frombuffer(("abra cadabra " * 30 + "xyz" * 100 + "abra cadabra " * 9).encode(), dtype=np.uint8)
    starts = np.arange(0, len(data) - length + 1)
    whole = data.tobytes()
    order = suffix_dedup.Suffixes(data, starts, length).order
    assert order.tolist() == sorted(starts.tolist(), key=lambda i: (whole[i : i + length], i))
    source = suffix_dedup.previous_factors(data, starts, length)
    for i in starts:
        first = whole.find(whole[i : i + length])
        assert (source[i] >= 0) == (first < i)
        assert source[i] < 0 or whole[source[i] : source[i] + length] == whole[i : i + length]


@pytest.mark.parametrize("seed", range(12))
def test_longest_previous_factors(seed):
    """Lengths, of eight and more, against the longest match with any earlier start."""
    draw = np.random.default_rng(seed)
    n, length = int(draw.integers(1, 140)), int(draw.integers(8, 40))
    data = draw.integers(97, 97 + draw.integers(1, 4), n + length, dtype=np.uint8)
    starts = np.flatnonzero(draw.random(n) < 0.8) if seed % 2 else np.arange(n)
    if seed == 3:
        data[:] = 97
    factor, source = suffix_dedup.longest_previous_factors(data, starts, length)
    whole = data.tobytes()

    def shared(i, j):
        return next((k for k in range(length) if whole[i + k] != whole[j + k]), length)

    for x, i in enumerate(starts):
        want = max((shared(i, j) for j in starts[:x]), default=0)
        assert factor[x] == want
        assert source[x] < x and (source[x] < 0) == (want == 0)
        assert source[x] < 0 or shared(i, starts[source[x]]) == want


def test_nearest_smaller_values():
    draw = np.random.default_rng(1)
    for n in (0, 1, 2, 50, 400):
        for values in (draw.permutation(n), np.arange(n), np.arange(n)[::-1]):
            shared = draw.integers(0, 9, n)
            at, least = suffix_dedup.previous_smaller(values, shared)
            for i in range(n):
                before = [j for j in range(i) if values[j] < values[i]]
                assert at[i] == (before[-1] if before else -1)
                assert least[i] == (min(shared[before[-1] + 1 : i + 1]) if before else 0)


def words_of(text):
    folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", folded)


def brute_classes(rows, percent, width):
    sets = []
    for _, t in rows:
        w = words_of(t)
        own = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}
        sets.append(own or ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            linked = both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both)
            same_id = rows[i][0] == rows[j][0]
            if rows[i][0] is not None and rows[j][0] is not None and (linked or same_id and sets[i] and sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    return [(d, len(s), None if d is None else least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


@pytest.mark.parametrize("percent,width", [(85, 3), (80, 5)])
def test_near_duplicates(spark, docs, rows, percent, width):
    near = []
    for i, (_, t) in enumerate(rows[:25]):
        w = (t or "").split()
        for k in range(3):
            edited = list(w)
            for at in range(k + 1, len(w), 45 - 8 * k):
                edited[at] = f"new{k}"
            near.append((1000 + 10 * i + k, " ".join(edited).upper() if k == 1 else " ".join(edited)))
    extra = spark.createDataFrame(near, "doc_id long, text string")
    every = [*rows, *near]
    got = near_dedup.near_duplicates(docs.select("doc_id", "text").union(extra), percent, width).collect()
    want = brute_classes(every, percent, width)
    assert sorted(map(str, ((r.doc_id, r.n_shingles, r.component_id) for r in got))) == sorted(map(str, want))
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)
    assert sum(d != c for d, _, c in want if d is not None) > 10


def test_crossing_pairs_in_tiles(spark, monkeypatch):
    """Members of different components meet whatever the number of tiles."""
    monkeypatch.setattr(near_dedup, "TILE", 3)
    rows = spark.createDataFrame([(7, i, i % 4) for i in range(20)], "key long, node long, root long")
    nodes = spark.createDataFrame(
        [(i, 100, [0] * 16, bytearray(64)) for i in range(20)], "node long, n long, sketch array<long>, whole binary"
    )
    got = {(r.a, r.b) for r in near_dedup._cross_pairs(rows, nodes, 85).collect()}
    assert got == {(a, b) for a in range(20) for b in range(a + 1, 20) if a % 4 != b % 4}


def test_set_sketches_never_lose_a_pair():
    draw = np.random.default_rng(3)
    for n in (3, 10, 60, 400, 5000):
        base = draw.integers(0, 1 << 63, n, dtype=np.uint64)
        for differing in (0, n // 20, n // 12, n // 8, n // 4):
            other = base.copy()
            other[:differing] = draw.integers(0, 1 << 63, differing, dtype=np.uint64)
            other = other[: max(1, n - draw.integers(0, n // 10 + 1))]
            x, y = np.sort(base), np.sort(other)
            whole = near_dedup.set_sketches(np.concatenate((x, y)), np.array([0, len(x), len(x) + len(y)]))
            members = near_dedup.Members(np.array([len(x), len(y)]), np.zeros((2, 16), np.uint64), whole, 85)
            both = len(np.intersect1d(x, y))
            similar = 100 * both >= 85 * (len(x) + len(y) - both)
            passes = len(members.may_link(0, np.array([1]))) > 0
            assert passes or not similar
            clearly_not = 100 * both < 80 * (len(x) + len(y) - both)
            assert not (passes and clearly_not and n >= 60)


def test_long_chains_become_one_component(spark):
    links = [(i, i + 1) for i in range(300)] + [(1000, 999), (1000, 1001)]
    got = near_dedup.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {(r.node, r.root) for r in got} == {(i, 0) for i in range(1, 301)} | {(1000, 999), (1001, 999)}
