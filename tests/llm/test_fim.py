"""Fill-in-the-middle against a plain version, and round trips."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from hard_rows import docs, no_docs, rows  # noqa: F401  fixtures
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gazewatch.llm import fim


def brute(doc_id, text):
    text = text or ""
    n = len(text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in range(0, 32, 8))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"


def check(frame, rows):
    got = fim.transform(frame).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    key = lambda r: tuple((v is not None, v) for v in r)
    want = sorted([(i, *brute(i, t), t or "") for i, t in rows], key=key)
    assert sorted([tuple(r) for r in got], key=key) == want
    return want


def test_odd_rows(docs, rows, no_docs):  # noqa: F811
    assert {w[2] for w in check(docs, rows)} == {"plain", "psm", "spm"}
    check(no_docs, [])


def test_long_marked_and_wide_texts(spark):
    draw = random.Random(5)
    letters = "ab é日😀\n<>PSM"
    found = [(i, "".join(draw.choice(letters) for _ in range(draw.randint(0, 3000)))) for i in range(40)]
    found += [(100 + i, t) for i, t in enumerate(["<P", "<P>", "x<S>y", "<M", "é" * 3_000_000, "a" * 5000, "<" * 300 + "S>"])]
    found += [(200 + i, "x" * (62 + i) + "<M>" + "y" * 100) for i in range(5)]  # markers near and across edges
    check(spark.createDataFrame(found, "doc_id long, text string"), found)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="<>PSMa", max_size=12), st.integers(0, 12), st.integers(0, 12))
def test_parts_are_told_apart(text, a, b):
    """No marker arises where a part meets a marker."""
    a, b = sorted((min(a, len(text)), min(b, len(text))))
    if not any(m in text for m in ("<P>", "<S>", "<M>")):
        out = f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"
        assert sum(out.count(m) for m in ("<P>", "<S>", "<M>")) == 3


def test_summaries_combine():
    draw = random.Random(8)
    for _ in range(300):
        parts = ["".join(draw.choice("<>PSMé") for _ in range(draw.randint(0, 4))).encode() for _ in range(4)]
        whole = fim.EMPTY
        for p in parts:
            whole = fim.combined(whole, fim.summary_of(p))
        assert whole == fim.summary_of(b"".join(parts))


def test_chunks_follow_content():
    draw = np.random.default_rng(3)
    passage = draw.integers(32, 127, 20_000, dtype=np.uint8)

    def chunks(data):
        limits = fim.chunk_limits(data, 0, len(data), fim.cut_places(data))
        assert limits[-1] == len(data) and limits[0] == 0
        assert all(b - a <= fim.MOST + 3 for a, b in zip(limits, limits[1:], strict=False))
        return {data[a:b].tobytes() for a, b in zip(limits, limits[1:], strict=False)}

    alone, shifted = chunks(passage), chunks(np.concatenate((draw.integers(32, 127, 77, dtype=np.uint8), passage)))
    assert len(alone & shifted) > 0.9 * len(alone)
    assert len(fim.cut_places(np.full(3 * fim.BLOCK, 97, dtype=np.uint8))) <= 1


def test_blocks_do_not_show():
    data = np.random.default_rng(4).integers(0, 255, 3000, dtype=np.uint8)
    whole = fim.cut_places(data)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(fim, "BLOCK", 100)
        assert set(whole.tolist()) ^ set(fim.cut_places(data).tolist()) == set()


def test_the_memo_is_bounded():
    memo = fim.ChunkMemo(bound=5000)
    for i in range(1000):
        assert memo[b"%d" % i].points == len(str(i))
        assert memo.held <= 5000 and len(memo) <= 16
