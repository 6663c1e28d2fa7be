"""Rows that every operator must stand: nulls, empty and long texts, ties, repeated rows."""

from __future__ import annotations

import random

import pytest

WORDS = "alpha beta gamma delta épsilon zeta eta theta iota kappa".split()


def texts(seed: int, n: int = 50) -> list[str]:
    """Random texts that share passages, so that repeats of all lengths occur."""
    draw = random.Random(seed)
    say = lambda k: " ".join(draw.choice(WORDS) for _ in range(k))
    passages = [say(draw.randint(8, 60)) for _ in range(5)]
    found = []
    for _ in range(n):
        parts = [draw.choice(passages) if draw.random() < 0.5 else say(draw.randint(0, 40)) for _ in range(draw.randint(0, 4))]
        found.append(draw.choice(["\n", " "]).join(parts))
    return found


@pytest.fixture
def rows() -> list[tuple[int | None, str | None]]:
    found: list[tuple[int | None, str | None]] = list(enumerate(texts(3)))
    odd = [None, "", " \n ", "one", "one two", "word " * 3000, " ".join(map(str, range(400))), "a\x00b \t c"]
    found += [(100 + i, t) for i, t in enumerate(odd)]
    return found + [found[0], found[0], (3, found[7][1]), (None, found[2][1]), (None, None)]


@pytest.fixture
def docs(spark, rows):
    """The rows with extra columns whose names the operators use for their own."""
    wide = [(i, t, "x", 1, "en", "s") for i, t in rows]
    return spark.createDataFrame(
        wide, "doc_id long, text string, block string, n_words int, lang string, source string"
    )


@pytest.fixture
def no_docs(docs):
    return docs.limit(0)
