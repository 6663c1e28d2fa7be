"""Token counts, pieces, packing, fingerprints, quality, licenses and languages."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hard_rows import docs, no_docs, rows  # noqa: F401  fixtures
from hypothesis import given, settings
from hypothesis import strategies as st

from gazewatch.llm import bpe, iblt, language, licenses, memo, packing, quality, unigram
from gazewatch.llm.common import Memo
from gazewatch.llm.queries import vocabulary

ODD = [
    "", " ", "a  b", " a", "a ", "a\n\nb", "x\n y", "\n", "a\tb", "İstanbul ΣΑΣ ς", "éa ́b",
    "<|endoftext|>a <|startoftext|>", "a<|endoftext|>b", "a\x1cb \x1f", "▁a ▁", "日本語 テスト", "😀 x😀😀",
    "it's we'LL 123 45", " x y", "a b\u0085c", "a\r\nb", "ﬁ Ǆ ẞ K Å", "don't 'sx's", "a\x00b", "end.\nNext, (one)",
]
TEXT = st.text(alphabet="ab  \n\t'sé́.,(1İ　😀▁<|>Σ", max_size=40)


def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary(name))


@settings(max_examples=60, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=20))
def test_counts_are_the_library_s(texts):
    encoded = library_of("word_bpe_49k.json").encode_batch(ODD + texts, add_special_tokens=False)
    got = bpe.counter(vocabulary("word_bpe_49k.json")).count([t.encode() for t in ODD + texts])
    assert got.tolist() == [len(e.ids) for e in encoded]


@settings(max_examples=60, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=20))
def test_ids_are_the_library_s(texts):
    encoded = library_of("byte_bpe_50k.json").encode_batch(ODD + texts, add_special_tokens=False)
    got = packing.byte_encoder(vocabulary("byte_bpe_50k.json")).encode([t.encode() for t in ODD + texts])
    assert [g.tolist() for g in got] == [e.ids for e in encoded]


_LIBRARIES: dict = {}


def library_of(name):
    return _LIBRARIES.setdefault(name, library(name))


@settings(max_examples=80, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=20))
def test_pieces_decode_to_the_text(texts):
    work = unigram.encoder(vocabulary("piece_bpe_32k.model"))
    encoded = work.encode([t.encode() for t in ODD + texts])
    assert [work.decode(ids).decode() if ids else "" for ids in encoded] == ODD + texts


def test_best_path_is_the_best_of_all_paths():
    draw = random.Random(5)
    pieces = {"".join(p): None for n in (1, 2, 3) for p in [draw.choices("abc▁", k=n) for _ in range(12)]}
    scored = {p: (256 + i, -draw.random() * 9) for i, p in enumerate(pieces)}
    own = unigram.Pieces(scored, list(range(256)), 256 + len(scored))

    def best(text):
        if not text:
            return 0.0
        options = [own.scores[i] + best(text[len(p) :]) for p, (i, _) in scored.items() if text.startswith(p.replace("▁", " "))]
        if text[0].replace(" ", "▁") not in scored:
            options.append(own.fallback + best(text[1:]))
        return max(options)

    for _ in range(200):
        text = "".join(draw.choices("abcd é", k=draw.randint(1, 7)))
        ids = own.best(text.encode())
        assert b"".join(own.bytes[i] for i in ids) == text.encode()
        bytes_scored = [i for i in ids if i < 256]
        score = sum(own.scores[i] for i in ids if i >= 256)
        chars = b"".join(own.bytes[i] for i in bytes_scored).decode()
        assert score + own.fallback * len(chars) == pytest.approx(best(text))


def test_paths_abreast_are_the_best_paths(monkeypatch):
    draw = random.Random(8)
    pieces = {"".join(p): None for n in (1, 2, 3) for p in [draw.choices("abcé▁", k=n) for _ in range(12)]}
    # Few different scores, so that many paths are equal.
    scored = {p: (256 + i, -float(draw.randint(1, 3))) for i, p in enumerate(pieces)}
    own = unigram.Pieces(scored, list(range(256)), 256 + len(scored))
    texts = ["".join(draw.choices("abcd éß日😀\n\x00", k=draw.randint(1, 9))) for _ in range(400)]
    texts += ["a" * 300, "ab é" * 40, texts[0], "日" * 21 + "x"]
    keys = [t.encode() for t in texts]
    for size in (unigram.ABREAST_BYTES, 64):
        monkeypatch.setattr(unigram, "ABREAST_BYTES", size)
        ids, sizes = own.best_of(keys)
        found = [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]
        assert found == [own.best(k).tolist() for k in keys]


def test_heads_of_pieces_are_their_first_bytes():
    """Pieces of equal hash are told apart by their first eight bytes and their length."""
    texts = [b"abcdefgh", b"abcdefghi", b"a", b"ab", b"a\x00", b"xbcdefgh"]
    data, limits = memo.laid_out(texts)
    own = memo.PieceMemo(lambda ps: (np.array([len(p) for p in ps]), np.ones(len(ps), dtype=np.int64)))
    own.take(data, limits[:-1], limits[1:])
    heads = {(len(t) << 40) ^ int.from_bytes(t[:8].ljust(8, b"\0"), "little") for t in texts}
    assert set(own.checks[: len(own.checks)].tolist()) == set(memo.mixed(np.array(sorted(heads), dtype=np.uint64)).tolist())


def test_words_are_cut_before_their_signs():
    texts = ["ab$$$ ab&&& cd### cd*** ab's $ab a-b_c d/e x=1 [a] {b} ~c 9% 9$ \"q\" it'll-'s <|endoftext|>$a a<b|c>", "ab$", "é$$ é# ñ-'t"]
    seen = []
    work = packing.ByteEncoder(vocabulary("byte_bpe_50k.json"))
    work.memo.compute = lambda ps, f=work.memo.compute: seen.extend(ps) or f(ps)
    want = [e.ids for e in library_of("byte_bpe_50k.json").encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in work.encode([t.encode() for t in texts])] == want
    assert {b"$$$", b"&&&", b"###", b"***"} <= set(seen) and b" ab$$$" not in seen


def test_double_array_finds_all_prefixes():
    keys = {k: i for i, k in enumerate([b"a", b"ab", b"abc", b"b", "é".encode(), b"\xff", b"\x00\x01"])}
    trie = unigram.DoubleArray(keys)
    assert list(trie.matches(b"xabcd", 1)) == [(2, 0), (3, 1), (4, 2)]
    assert list(trie.matches("é".encode(), 0)) == [(2, 4)]
    assert list(trie.matches(b"\xff\x00\x01", 1)) == [(3, 6)]
    assert list(trie.matches(b"c", 0)) == []


def test_merging_follows_ranks():
    ranks = {("a", "a"): 0, ("aa", "b"): 1, ("b", "a"): 2}
    assert bpe.merged_length(list("aaab"), ranks) == 3  # aa|a|b, the leftmost of equal pairs first
    assert bpe.merged_length(list("aab"), ranks) == 1
    assert bpe.merged_length(["x"], ranks) == 1


def test_memo_starts_anew_when_full():
    seen = []

    def lengths(pieces):
        seen.extend(pieces)
        return np.array([len(p) for p in pieces]), np.ones(len(pieces), dtype=np.int64)

    held = memo.PieceMemo(lengths, bound=8)
    for step in range(30):
        words = [b"x" * (1 + (step * 3 + i) % 17) for i in range(5 if step % 7 else 17)]
        data, limits = memo.laid_out(words)
        numbers, sizes = held.take(data, limits[:-1], limits[1:])
        assert numbers.tolist() == [len(w) for w in words] and set(sizes) == {1}
    assert len(held.checks) <= 17


def test_memo_is_bounded_by_bytes():
    """Long pieces count for their length; a batch that is too large by itself is not kept."""
    double = lambda pieces: (np.concatenate([np.full(len(p), len(p)) for p in pieces]), np.array([len(p) for p in pieces]))
    held = memo.PieceMemo(double, most_bytes=1000)
    for step in range(40):
        words = [b"y" * (1 + (step * 7 + i) % 120) for i in range(12 if step % 9 else 40)]
        data, limits = memo.laid_out(words)
        numbers, sizes = held.take(data, limits[:-1], limits[1:])
        assert sizes.tolist() == [len(w) for w in words]
        assert numbers.tolist() == [len(w) for w in words for _ in w]
    assert len(held.flat) <= 5000
    words = Memo(lambda ws: [len(w) for w in ws], bound=100, most_chars=50)
    for i in range(60):
        words.learn({"z" * (1 + i % 30)})
        assert words["z" * (1 + i % 30)] == 1 + i % 30 and sum(map(len, words)) <= 60


def test_long_texts_without_blanks():
    """One text of 60,000 letters with nothing to cut it at, and a text of one letter."""
    draw = random.Random(6)
    texts = ["".join(draw.choice("日本語テストé") for _ in range(60_000)), "a" * 30_000]
    data = [t.encode() for t in texts]
    for name, own in (("word_bpe_49k.json", bpe.counter), ("byte_bpe_50k.json", packing.byte_encoder)):
        want = [len(e.ids) for e in library_of(name).encode_batch(texts, add_special_tokens=False)]
        work = own(vocabulary(name))
        assert (work.count(data).tolist() if own is bpe.counter else [len(x) for x in work.encode(data)]) == want
    work = unigram.encoder(vocabulary("piece_bpe_32k.model"))
    assert [work.decode(ids).decode() for ids in work.encode(data)] == texts


def test_counts_of_rows(docs, rows, no_docs):
    got = bpe.count_tokens(docs, vocabulary("word_bpe_49k.json")).collect()
    want = library_of("word_bpe_49k.json").encode_batch([t or "" for _, t in rows], add_special_tokens=False)
    wanted = [(str(d), len((t or "").encode()), len(e.ids)) for (d, t), e in zip(rows, want, strict=True)]
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == sorted(wanted)
    assert bpe.count_tokens(no_docs, vocabulary("word_bpe_49k.json")).count() == 0


def test_pieces_of_rows(spark, docs, rows, no_docs):
    model = vocabulary("piece_bpe_32k.model")
    got = unigram.piece_counts(spark, docs, model).collect()
    digest = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    assert sorted(r.decoded_sha256 for r in got) == sorted(digest(t) for _, t in rows)
    assert unigram.piece_counts(spark, no_docs, model).count() == 0


@pytest.mark.parametrize("window", [16, 1024])
def test_packing_holds_each_id_once(docs, rows, no_docs, window):
    path = vocabulary("byte_bpe_50k.json")
    encoded = library_of("byte_bpe_50k.json").encode_batch([t or "" for _, t in rows], add_special_tokens=False)
    want = Counter((str(d), tuple([*e.ids, 0])) for (d, _), e in zip(rows, encoded, strict=True))
    pieces = packing.pack(docs, path, window=window).collect()
    sequences = defaultdict(list)
    for p in pieces:
        assert len(p.ids) == 4 * p.length > 0
        sequences[p.sequence_id].append(p)
    for own in sequences.values():
        own.sort(key=lambda p: p.offset)
        ends = np.cumsum([p.length for p in own])
        assert [p.offset for p in own] == [0, *ends[:-1]]
        assert ends[-1] <= window and (ends[-1] == window or ends[-1] & (ends[-1] - 1) == 0)
    # Pieces of rows that share an id and a length may be told apart by their ids only.
    ids = Counter()
    for (doc, tokens), times in want.items():
        own = [p for p in pieces if str(p.doc_id) == doc and p.doc_tokens == len(tokens)]
        assert sum(p.length for p in own) % len(tokens) == 0
        for p in own:
            ids[doc] += tuple(np.frombuffer(p.ids, dtype="<u4")) == tokens[p.start : p.start + p.length]
        assert ids[doc] >= times
    assert sum(p.length for p in pieces) == sum(len(t) * n for (_, t), n in want.items())
    assert packing.pack(no_docs, path).count() == 0


def test_neighbours_share_rare_terms():
    draw = np.random.default_rng(1)
    common = draw.integers(0, 20, (40, 60))
    docs = [np.concatenate((c, [1000 + i % 8] * 3)).astype(np.uint32) for i, c in enumerate(common)]
    index = packing.Shard(docs)
    unused = np.ones(40, dtype=bool)
    unused[3] = False
    assert {int(i) % 8 for i in index.neighbours(3, unused)[:4]} == {3}
    unused[11] = False
    assert 11 not in index.neighbours(3, unused)


def test_neighbours_meet_wherever_they_are_stored(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_DOCS", 20)
    path = vocabulary("byte_bpe_50k.json")
    words = [w[1:] for w in sorted(library_of("byte_bpe_50k.json").get_vocab()) if w[0] == "Ġ" and w[1:].isascii() and len(w) > 8]
    # 50 topics of four rows each, spread over eight partitions.
    rows = [(i, f"the house and the {words[i % 50 * 9]} of {words[i % 50 * 9 + 4]} {i % 7}") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    shards = {p.doc_id: p.sequence_id >> 33 for p in packing.pack(df, path, window=32).collect()}
    assert len(set(shards.values())) >= 8 and max(Counter(shards.values()).values()) <= 40
    pairs = [(i, j) for i in range(200) for j in range(i + 50, 200, 50)]
    assert sum(shards[i] == shards[j] for i, j in pairs) >= 0.8 * len(pairs)


def test_statistics_are_those_of_all_rows(spark, docs, rows, no_docs):
    path = vocabulary("byte_bpe_50k.json")
    found = library_of("byte_bpe_50k.json").encode_batch([t or "" for _, t in rows], add_special_tokens=False)
    want = Counter(i for e in found for i in {*e.ids, 0})
    n, tokens, frequency = packing.document_frequencies(packing.encoded(docs.repartition(6), path, "doc_id", "text"))
    assert (n, tokens) == (len(rows), sum(len(e.ids) + 1 for e in found))
    assert {int(i): int(frequency[i]) for i in np.flatnonzero(frequency)} == want
    assert packing.document_frequencies(packing.encoded(no_docs, path, "doc_id", "text"))[:2] == (0, 0)


def test_whole_windows_take_part_in_retrieval():
    # Documents 0 and 3 have only the terms of their first window in common.
    docs = [[900] * 8 + [1, 2, 3, 4], [5] * 6, [6] * 6, [900] * 8 + [7, 8, 9, 10]]
    packed = list(packing.pack_shard([np.array(d, dtype=np.uint32) for d in docs], 8))
    first = next(s for s in packed if s[0][:2] == (0, 8))
    assert first[1][0] == 3


def test_all_terms_of_a_seed_are_scored():
    draw = np.random.default_rng(4)
    docs = [draw.integers(0, 400, draw.integers(1, 90)).astype(np.uint32) for _ in range(60)]
    idf, mean = draw.random(400) + 0.1, 50.0
    index = packing.Shard(docs, idf, mean)
    unused = draw.random(60) < 0.8
    for seed in range(60):
        want = []
        for i, doc in enumerate(docs):
            score, norm = 0.0, packing.K1 * (1 - packing.B + packing.B * len(doc) / mean)
            for t in set(docs[seed].tolist()):
                times = int((doc == t).sum())
                score += idf[t] * times * (packing.K1 + 1) / (times + norm)
            if unused[i] and score:
                want.append((-round(score, 9), i))
        assert index.neighbours(seed, unused).tolist() == [i for _, i in sorted(want)]
        assert list(index.ranked(seed, unused)) == [i for _, i in sorted(want)]


def paragraphs(text):
    return {line[i : i + 400] for line in text.split("\n") for i in range(0, len(line), 400)}


def alike(a, b):
    return 1.0 if not a | b else len(a & b) / len(a | b)


def test_fingerprints(spark, no_docs):
    draw = random.Random(2)
    lines = [" ".join(draw.choices("ab cd ef gh ij".split(), k=6)) for _ in range(400)]
    rows = [(i * 7, "\n".join(draw.sample(lines, draw.choice([0, 1, 3, 20, 90])))) for i in range(40)]
    rows += [(1000, None), (1001, ""), (1002, rows[5][1]), (1003, rows[5][1]), (1004, "é😀" * 900)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r for r in iblt.fingerprints(df).collect()}
    ordered = sorted(((d, t or "") for d, t in rows), reverse=True)
    for i, (doc_id, text) in enumerate(ordered):
        following = ordered[(i + 1) % len(ordered)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        r = got[doc_id]
        assert (r.n_chars, r.edited) == (len(text), edited)
        assert r.near_edited == pytest.approx(alike(paragraphs(text), paragraphs(edited)))
        assert r.near_next == pytest.approx(alike(paragraphs(text), paragraphs(following)))
    assert got[1002].fingerprint == got[1003].fingerprint == got[35].fingerprint
    assert got[1000].fingerprint == got[1001].fingerprint == ""
    assert iblt.fingerprints(no_docs).count() == 0


def test_fingerprints_of_odd_rows(docs, rows):
    got = iblt.fingerprints(docs).collect()
    assert Counter(str(r.doc_id) for r in got) == Counter(str(d) for d, _ in rows)


def test_larger_sketches_follow_a_failure(spark):
    from pyspark.sql import functions as F

    df = spark.range(3).select(
        F.when(F.col("id") == 0, F.sequence(F.lit(1), F.lit(5))).when(F.col("id") == 1, F.sequence(F.lit(1), F.lit(900)))
        .otherwise(F.sequence(F.lit(1), F.lit(300))).cast("array<long>").alias("a"),
        F.sequence(F.lit(4), F.lit(303)).cast("array<long>").alias("b"),
    )
    df = df.withColumns({"ca": iblt.base_sketch(F.col("a")), "cb": iblt.base_sketch(F.col("b"))})
    got = [r[0] for r in df.select(iblt.likeness(*map(F.col, ("a", "b", "ca", "cb")))).collect()]
    want = [alike(set(range(1, n + 1)), set(range(4, 304))) for n in (5, 900, 300)]
    assert got == pytest.approx(want)


def test_quality_metrics(docs, rows, no_docs):
    got = quality.judge(docs).collect()
    want = []
    for doc_id, t in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        at = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        repeated = sum(
            any(at[tuple(words[i : i + 8])] > 1 for i in range(max(0, k - 7), min(k, len(words) - 8) + 1))
            for k in range(len(words))
        )
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        failed = len(words) < 20 or 100 * repeated > 30 * len(words)
        want.append((str(doc_id), len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), repeated, failed))
    keys = "n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed".split()
    assert sorted((str(r.doc_id), *[r[k] for k in keys]) for r in got) == sorted(want)
    assert not any(r.kept for r in got if r.base_failed)
    assert quality.judge(no_docs).count() == 0


def test_rules_name_what_is_broken(spark):
    good = "the house of the man is in the town and it has a door " * 1 + "that no one of us can open with a key or by hand"
    texts = [good, "### $$$ " + good + " %%% &&& ***" * 4, "zyx " * 2 + " ".join(f"w{i}" for i in range(40)), "kurz"]
    got = quality.judge(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [r.broken for r in got][:2] == [[], ["symbols"]]
    assert "stop_words" in got[2].broken and "length" in got[3].broken
    assert [r.kept for r in got] == [True, False, False, False]


def license_places(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(str.maketrans(licenses.UPPER, licenses.LOWER)))
    at = []
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        at += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    return words, at


NOTICES = [
    "Released under the MIT License.", "x MIT   license, MIT-License mit licenses", "Licensed under CC BY-NC 4.0.",
    "GNU General Public License and the Apache License", "GNU general\npublic license gnu", "écc by cc by", "cc", "by cc-by",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software)",
    "mit " * 50 + "license", "apache license " * 40,
]


def test_licenses(spark, docs, rows, no_docs):
    df = spark.createDataFrame([(500 + i, t) for i, t in enumerate(NOTICES)], "doc_id long, text string")
    every = [*rows, *[(500 + i, t) for i, t in enumerate(NOTICES)]]
    got = licenses.scan(docs.select("doc_id", "text").union(df)).collect()
    want = []
    for doc_id, t in every:
        words, at = license_places(t or "")
        labels = ",".join(sorted({label for _, label in at}))
        places = [i for i, _ in at]
        want.append((doc_id, len(words), len(at), min(places, default=None), max(places, default=None), labels))
    key = "doc_id n_words n_base first_word last_word base_labels".split()
    assert sorted(str(tuple(r[k] for k in key)) for r in got) == sorted(map(str, want))
    by_id = {r.doc_id: r for r in got}
    assert by_id[502].labels == "cc-by,cc-by-nc" and by_id[508].labels == "mit" and by_id[508].base_labels == ""
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in got)
    assert all(0 <= r.score <= 1 for r in got)
    assert licenses.scan(no_docs).count() == 0


def brute_shares(words, weights):
    """{label: the best share} of all templates around each place of their key, without an index."""
    found = {}
    for number, t in enumerate(licenses.TEMPLATES):
        key, own = licenses.plain_words(t.key), [r for r in licenses.template_words() if r[1] == number]
        first = min(place for _, _, _, place, mandatory in own if mandatory)
        total = sum(weights[w] for w, *_ in own)
        for at in range(len(words)):
            if words[at : at + len(key)] != key:
                continue
            anchor, agreeing = at - first, 0.0
            for w, _, _, place, _ in own:
                low = max(0, anchor + place - licenses.SLACK)
                agreeing += weights[w] * (w in words[low : max(0, anchor + place + licenses.SLACK + 1)])
            share = round(min(1.0, agreeing / total), 9)
            if share >= licenses.LEAST_SHARE:
                found[t.label] = max(found.get(t.label, 0), share)
    return found


def test_notices_are_those_found_without_the_index(spark):
    """Notices whole, damaged, with words put in and left out, one frequent, in long texts."""
    draw, texts = random.Random(12), []
    for t in licenses.TEMPLATES:
        texts.append(t.wording)
        for _ in range(3):
            words = t.wording.split()
            for _ in range(draw.randint(0, len(words) // 3)):
                at = draw.randrange(len(words))
                words[at : at + draw.randint(0, 1)] = draw.choices(["foo", "license", "copy", "bar", "software"], k=draw.randint(0, 2))
            texts.append("pad " * draw.randint(0, 40) + " ".join(words) + " pad" * draw.randint(0, 9))
    texts += [" ".join(draw.sample(texts, 3)) for _ in range(15)] + [licenses.TEMPLATES[4].wording] * 30 + ["license software the"] * 20
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    weights = licenses.word_weights(licenses.word_hits(frame))
    got = {r.doc_id: r for r in licenses.scan(frame).collect()}
    labels = set()
    for i, text in enumerate(texts):
        words, at = license_places(text)
        shares = brute_shares(words, weights)
        assert got[i].labels == ",".join(sorted({label for _, label in at} | set(shares)))
        assert got[i].score == pytest.approx(1.0 if at else max(shares.values(), default=0.0), abs=1e-6)
        labels |= set(shares)
    assert labels == {t.label for t in licenses.TEMPLATES} and len(labels) >= 20
    for t in licenses.TEMPLATES:
        key = [w in licenses.COMMON for w in licenses.plain_words(t.key)]
        assert all(not all(key[max(0, i - 1) : i + 2]) for i in range(len(key)))
    posted = {n for _, n, *_ in licenses.rare_postings(weights)[0]}
    assert len(posted) == len(licenses.TEMPLATES)
    assert len(licenses.rare_postings(weights)[0]) < len(licenses.template_words()) / 2


def test_licenses_of_a_text_with_many_notices(spark):
    by_label = {t.label: " ".join(t.words) for t in licenses.TEMPLATES if t.label in ("bsd", "apache", "mpl", "lgpl")}
    several = " ".join([t.wording for t in licenses.TEMPLATES if t.label in ("mit", "bsd")] + ["and licensed under cc by nc 4 0"])
    texts = [several, " so ".join([several, *by_label.values()])]
    # The notice is frequent, so its words are the least rare ones of the long texts.
    texts += ["licensed under cc by nc 4 0"] * 60
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(df).collect()}
    assert got[0].labels == "bsd,cc-by,cc-by-nc,mit"
    assert set(got[1].labels.split(",")) == {"bsd", "mit", "cc-by", "cc-by-nc", "apache", "mpl", "lgpl"}


def test_languages(spark, no_docs):
    draw = random.Random(4)
    stock = {
        "en": "the and of that with house water mother which there would",
        "de": "der und die nicht haus wasser mutter welche würde schön über",
        "fr": "le et les dans maison eau mère quelle serait où être",
        "es": "el y los casa agua madre cual sería niño está según",
    }
    rows = []
    for i in range(240):
        lang = draw.choice(list(stock))
        text = " ".join(draw.choices(stock[lang].split(), k=draw.randint(20, 60)))
        said = draw.choice([lang, lang, lang, lang, draw.choice(list(stock)), None, "xx"])
        rows.append((i, text, said, draw.choice(["a", "b", None]), lang))
    rows += [(900, None, "en", "a", None), (901, "", None, None, None), (902, "12 34 ||| 56", "de", "a", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, truth string")
    got = {r.id: r for r in language.identify_documents(df).collect()}
    right = [got[i].language == truth for i, *_, truth in rows if truth]
    assert sum(right) >= 0.98 * len(right)
    assert all(got[i].kept for i, *_, truth in rows if truth)
    assert [got[i].language for i in (900, 901, 902)] == [None] * 3 and not any(got[i].kept for i in (900, 901, 902))
    kept = language.keep_identified(df).collect()
    assert {r.doc_id for r in kept} == {r.id for r in got.values() if r.kept}
    assert set(kept[0].asDict()) == {"doc_id", "text", "lang", "source", "truth"}
    assert language.identify_documents(df.limit(0)).count() == 0


def trigrams(text):
    """Hash buckets of a text's trigrams, by the definition."""
    fold = lambda b: b | 32 if 97 <= b | 32 <= 122 else b if b >= 128 else 32
    data, found = [32, 32, *map(fold, (text or "").encode()), 32, 32], []
    for a, b, c in zip(data, data[1:], data[2:], strict=False):
        code = a << 16 | b << 8 | c
        if code != 0x202020:
            for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 1):
                code = (code ^ code >> 33) * factor % (1 << 64)
            found.append(code >> 50)
    return found


def brute_posteriors(rows, languages=language.LANGUAGES):
    """{id: (language, probability, kept)} of (id, text, declared, suffix, host)."""
    grams = {i: trigrams(t) for i, t, *_ in rows}
    counts = {name: Counter(g for i, _, said, *_ in rows if said == name for g in grams[i]) for name in languages}
    size = {name: sum(counts[name].values()) + language.BUCKETS for name in languages}
    found = {}
    for i, _, said, suffix, host in rows:
        others = [(d, s, h) for j, _, d, s, h in rows if j != i and d in languages]
        logs, fits = [], []
        for name in languages:
            share, n = 0.0, len(languages)
            every = (sum(d == name for d, _, _ in others) + 1) / (len(others) + n)
            near = [d for d, s, _ in others if s == suffix]
            of_suffix = (near.count(name) + language.SUFFIX_WEIGHT * every) / (len(near) + language.SUFFIX_WEIGHT)
            near = [d for d, s, h in others if (s, h) == (suffix, host)]
            of_host = (near.count(name) + language.HOST_WEIGHT * of_suffix) / (len(near) + language.HOST_WEIGHT)
            share = sum(math.log((counts[name][g] + 1) / size[name]) for g in grams[i]) / max(1, len(grams[i]))
            right = language.DECLARED_RIGHT
            told = 1.0 if said not in languages else right if said == name else (1 - right) / (n - 1)
            fits.append(share)
            weight = min(len(grams[i]), language.MOST_GRAMS) * language.EVIDENCE
            logs.append(share * weight + math.log(told) + math.log(of_host))
        best = max(range(len(languages)), key=lambda k: logs[k])
        probability = 1 / sum(math.exp(x - logs[best]) for x in logs)
        kept = bool(grams[i]) and probability >= language.LEAST_POSTERIOR and fits[best] + math.log(language.BUCKETS) >= language.LEAST_FIT
        found[i] = (languages[best] if grams[i] else None, probability, kept)
    return found


def test_posteriors_are_those_of_the_definition(spark):
    """Every row against plain Python; texts of a fifth language are mostly dropped."""
    draw = random.Random(14)
    stock = {
        "en": "the and of that with house water mother which there would",
        "de": "der und die nicht haus wasser mutter welche würde schön über",
        "fr": "le et les dans maison eau mère quelle serait où être",
        "es": "el y los casa agua madre cual sería niño está según",
        "ja": "ki ga wo ni hashi yama kawa sora hana tori",
    }
    rows = []
    for i in range(160):
        lang = draw.choice(list(stock)) if i % 4 else "ja"
        text = " ".join(draw.choices(stock[lang].split() + stock["en"].split()[: i % 3], k=draw.choice([1, 2, 5, 40])))
        said = draw.choice([lang, lang, None, "xx", draw.choice(list(stock))])
        rows.append((i, draw.choice([text] * 9 + ["", None, "12 - 3"]), said, draw.choice(["de", "com", None]), draw.choice(["h1", "h2", None])))
    frame = spark.createDataFrame(rows, "id long, text string, said string, suffix string, host string")
    want = brute_posteriors(rows)
    from pyspark.sql import functions as F

    columns = [F.col(c) for c in ("text", "said", "host", "suffix")]
    for parts in (1, 5):  # batches do not show in the result
        got = language.identify(frame.repartition(parts, "id"), "id", *columns).collect()
        assert len(got) == len(rows)
        for r in got:
            assert (r.language, r.kept) == (want[r.id][0], want[r.id][2])
            assert r.probability == pytest.approx(want[r.id][1], abs=2e-6)
    kept = Counter((i % 4 == 0, want[i][2]) for i, text, *_ in rows if text and len(text.split()) > 4)
    assert kept[True, False] > kept[True, True]
    assert {want[i][2] for i, *_ in rows} == {True, False}


def test_evidence_is_fused(spark):
    """Without text that tells, the declared language and the host decide."""
    pages = [(i, f"http://h{i % 2}.example.{'de' if i % 2 else 'com'}/x", f'<html lang="{"de" if i % 2 else "en"}"><p>ok</p>') for i in range(60)]
    pages += [(100, "http://h1.example.de/y", "<p>ok</p>"), (101, "https://h0.example.com", "<p>ok"), (102, None, None)]
    got = {r.id: r for r in language.identify_pages(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert (got[100].language, got[101].language, got[102].language) == ("de", "en", None)
    assert (got[100].host, got[100].suffix) == ("h1.example.de", "de")


def test_checksums_are_of_little_endian_ids(spark):
    df = spark.createDataFrame([(1, "Hello world")], "doc_id long, text string")
    from pyspark.sql import functions as F

    ids = library_of("byte_bpe_50k.json").encode("Hello world", add_special_tokens=False).ids
    # Three ids are not a power of two less than a window, so they come as two and one.
    pieces = packing.pack(df, vocabulary("byte_bpe_50k.json")).select("start", "length", F.crc32("ids").alias("c")).collect()
    for p in pieces:
        part = np.array([*ids, 0], dtype="<u4")[p.start : p.start + p.length]
        assert p.c == zlib.crc32(part.tobytes())
