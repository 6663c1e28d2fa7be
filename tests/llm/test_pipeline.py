"""The pipeline's stages against brute force, each on its own input, and all together."""

from __future__ import annotations

import random

import numpy as np
import pytest
from test_dedup import brute_classes

import corpus_pipeline
from gazewatch.llm.queries import vocabulary

EN = "the of and to in is it that for on house water mother there would river stone light green under".split()


@pytest.fixture(scope="module")
def corpus():
    draw = random.Random(11)
    say = lambda n: " ".join(draw.choice(EN) + draw.choice(["", "", "s", "ed", str(draw.randint(0, 99))]) for _ in range(n))
    shared = say(70)
    rows = [(i, say(draw.randint(25, 120)), "en", f"s{i % 3}") for i in range(30)]
    for i in range(30, 36):
        rows.append((i, say(40) + " " + shared + "\n" + say(30), "en", "s0"))
    for i, of in ((40, 3), (41, 3), (42, 31)):  # an exact copy and near copies
        words = rows[of][1].split()
        if i != 40:
            words[len(words) // 2] = "changed"
        rows.append((i, rows[of][1] if i == 40 else " ".join(words), "en", "s1"))
    junk = ["$$$ ### " * 30, "a b", "", None, "same words here again and the end " * 20, "12345 " * 40]
    rows += [(50 + i, t, "en", "s2") for i, t in enumerate(junk)]
    return [(*r, len(r[1] or "")) for r in rows]


def stage(spark, tmp_path, corpus, upto):
    docs = spark.createDataFrame(corpus, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    found = []
    for number, (_, step) in enumerate(corpus_pipeline.STAGES[:upto]):
        path = str(tmp_path / str(number))
        step(spark, docs, "").write.parquet(path)
        docs = spark.read.parquet(path)
        found.append(docs.collect())
    return found


def test_stages_are_named_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "language_id", "near_dedup", "suffix_dedup", "packing"]


def test_each_stage(spark, tmp_path, corpus):
    good, told, single, cut, packed = stage(spark, tmp_path, corpus, 5)
    for kept in (good, told, single, cut):
        assert set(kept[0].asDict()) == set(corpus_pipeline.COLUMNS)
    assert {r.doc_id for r in good} == {i for i, *_ in corpus if i < 50}  # clean ones stay, junk goes
    assert {r.doc_id for r in told} == {r.doc_id for r in good}
    classes = brute_classes([(r.doc_id, r.text) for r in told], 80, 5)
    assert {r.doc_id for r in single} == {root for _, _, root in classes}
    assert not {40, 41, 42} & {r.doc_id for r in single}

    seen: set = set()
    for r in sorted(single, key=lambda r: r.doc_id):
        data = r.text.encode()
        gone = [False] * len(data)
        for i in range(len(data) - 199):
            if data[i : i + 200] in seen:
                gone[i : i + 200] = [True] * 200
            seen.add(data[i : i + 200])
        (own,) = [c for c in cut if c.doc_id == r.doc_id]
        assert own.text.encode() == bytes(b for b, g in zip(data, gone, strict=True) if not g)
        assert own.n_chars == len(own.text)
    assert sum(len(r.text) for r in cut) < sum(len(r.text) for r in single)

    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    want = {r.doc_id: len(library.encode(r.text, add_special_tokens=False).ids) + 1 for r in cut}
    assert {r.doc_id: r.doc_tokens for r in packed} == want
    covered = {d: np.zeros(n, dtype=int) for d, n in want.items()}
    for r in packed:
        covered[r.doc_id][r.start : r.start + r.length] += 1
    assert all((c == 1).all() for c in covered.values())


def test_run_applies_the_stages(spark, tmp_path, corpus):
    docs = spark.createDataFrame(corpus, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = stage(spark, tmp_path / "stages", corpus, 5)[-1]
    key = lambda rows: sorted((r.doc_id, r.doc_tokens) for r in rows if r.start == 0)
    assert key(got) == key(want)


def test_an_empty_corpus(spark, tmp_path, corpus):
    docs = spark.createDataFrame(corpus[:1], "doc_id long, text string, lang string, source string, n_chars long").limit(0)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_null_columns_and_extra_ones(spark, corpus):
    rows = [(*r[:2], "en" if r[0] % 2 else None, None, None, "x", 1) for r in corpus[:12]] + [(None, None, None, None, None, None, None)]
    docs = spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, block string, n_words int"
    )
    for _, step in corpus_pipeline.STAGES[:4]:
        docs = step(spark, docs, "")
    assert {r.doc_id for r in docs.collect()} == {r[0] for r in corpus[:12]}


def test_ties_are_settled_alike_in_every_order(spark, corpus):
    rows = [(1, corpus[0][1], "en", "b", 5), (1, corpus[0][1], "en", "a", 5), (1, corpus[0][1], None, "a", 5), (1, corpus[1][1], "en", "z", 5)]
    rows += [(None, corpus[2][1], "en", s, 7) for s in "ba"] + [(2, corpus[3][1], "en", "c", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    got = [
        sorted(map(repr, corpus_pipeline.near_dedup_stage(spark, spark.createDataFrame(r, schema).repartition(n), "").collect()))
        for r, n in ((rows, 1), (rows[::-1], 3))
    ]
    assert got[0] == got[1] and len(got[0]) == 4


def test_the_language_stage_drops_rows(spark, tmp_path, corpus):
    """A row of a language that no row declares goes; the others stay."""
    strange = " ".join("ki ga wo ni hashi yama kawa sora hana tori".split() * 6)
    docs = spark.createDataFrame([*corpus[:30], (900, strange, None, None, len(strange))], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.language_id(spark, docs, "").collect()}
    assert 900 not in kept and kept == {r[0] for r in corpus[:30]}
