"""The mix of sources against plain Python."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from hard_rows import docs, no_docs, rows  # noqa: F401  fixtures

from gazewatch.llm import mixing


def fair_targets(sizes, weights, repeats):
    """Targets by sharing the excess again and again, in exact fractions."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full: dict = {}
    while len(full) < len(names):
        rest = sum(sizes.values()) - sum(full.values())
        open_ = [s for s in names if s not in full]
        share = {s: Fraction(rest * weight[s], sum(weight[t] for t in open_)) for s in open_}
        above = [s for s in open_ if share[s] > repeats * sizes[s]]
        if not above:
            return full | share
        full |= {s: Fraction(repeats * sizes[s]) for s in above}
    return full


def brute(documents, weights=(5, 2, 1), repeats=3, packet=1024, seed=12):
    """[(doc_id, size, source_size, target, taken)] and the stretches of the mix in order."""
    sized = [(d, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for d, s, t in documents]
    sizes: Counter = Counter()
    for _, s, n in sized:
        sizes[s] += n
    targets = fair_targets(sizes, weights, repeats)
    names = sorted((s for s in sizes if s is not None)) + [None]
    draw = lambda d: hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:16]
    entries, queues = [], defaultdict(list)
    for row, (d, s, n) in enumerate(sized):
        queues[s].append((draw(d), d is not None, d or 0, n, row))
    for s, held in queues.items():
        served = 0
        for epoch in range(repeats):
            for _, _, _, n, row in sorted(held):
                for first in range(0, n, packet):
                    words = min(packet, n - first)
                    entries.append((float(served + words) / float(targets[s]), names.index(s), served, row, epoch, first, words))
                    served += words
    left, gone, mix = sum(sizes.values()), Counter(), []
    for _, _, _, row, epoch, first, words in sorted(entries):
        words = min(words, left)
        left -= words
        gone[row] += words
        if words:
            mix.append((sized[row][0], epoch, first, words))
    found = [(d, n, sizes[s], float(targets[s]), gone[row]) for row, (d, s, n) in enumerate(sized)]
    return found, mix


def some(seed, n=150):
    draw = random.Random(seed)
    share = [None, "a", "b", "Z", "é", "z9", "hot", "hot", "hot", "hot", "hot"]
    return [(i, draw.choice(share), "w " * draw.choice([0, 1, 3, 40, 90, 2500])) for i in range(n)]


def key(rows):
    return sorted([tuple((v is not None, v) for v in r) for r in rows])


def rounded(rows):
    return [(d, n, m, round(t, 6), k) for d, n, m, t, k in rows]


@pytest.mark.parametrize("weights, repeats, packet, piece", [((5, 2, 1), 3, 1024, 16_384), ((1, 100), 2, 7, 4)])
def test_the_mix(spark, weights, repeats, packet, piece):
    documents = some(1)
    frame = spark.createDataFrame(documents, "doc_id long, source string, text string").repartition(5)
    options = dict(weights=weights, repeats=repeats, packet=packet)
    want, order = brute(documents, **options)
    got = mixing.taken(frame, **options, rows_per_piece=piece).collect()
    assert key(rounded(got)) == key(rounded(want))
    every, mixed = mixing.queue(frame, **options, rows_per_piece=piece)
    assert every.count() == len(documents)
    stretches = sorted(mixed.collect(), key=lambda r: r.begins)
    assert [(r.doc_id, r.epoch, r.first_word, r.words) for r in stretches] == order
    assert sum(r.words for r in stretches) == sum(n for _, n, *_ in want)
    for a, b in zip(stretches, stretches[1:], strict=False):
        assert a.begins + a.words == b.begins


def test_targets_are_met(spark):
    documents = some(2, 400)
    got = mixing.taken(spark.createDataFrame(documents, "doc_id long, source string, text string")).collect()
    names = {d: s for d, s, _ in documents}
    reached: Counter = Counter()
    for r in got:
        reached[names[r.doc_id]] += r.taken
        assert 0 <= r.taken <= 3 * r.size
    for r in got:
        assert abs(reached[names[r.doc_id]] - r.target) <= 2 * mixing.PACKET


def test_odd_rows(spark, docs, rows, no_docs):  # noqa: F811
    want, _ = brute([(i, "s", t) for i, t in rows])
    assert key(rounded(mixing.taken(docs).collect())) == key(rounded(want))
    assert mixing.taken(no_docs).collect() == []
    blank = spark.createDataFrame([(1, "a", None), (2, None, " "), (None, "b", "")], "doc_id long, source string, text string")
    assert {(r.doc_id, r.size, r.target, r.taken) for r in mixing.taken(blank).collect()} == {(1, 0, 0.0, 0), (2, 0, 0.0, 0), (None, 0, 0.0, 0)}


def test_one_source_takes_all(spark):
    documents = [(i, "only", "a b c") for i in range(20)]
    got = mixing.taken(spark.createDataFrame(documents, "doc_id long, source string, text string")).collect()
    assert all(r.taken == 3 and r.target == 60.0 for r in got)


def test_runs_agree(spark):
    documents = some(3)
    frame = spark.createDataFrame(documents, "doc_id long, source string, text string")
    first, second = (key(mixing.taken(f).collect()) for f in (frame.repartition(2), frame.repartition(7, "text")))
    assert first == second
