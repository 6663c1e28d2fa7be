import random
import re

import pytest
from pyspark.sql import functions as F

from gazewatch.functions import bloom, sizing
from gazewatch.operators import acts as A
from gazewatch.operators import needles
from gazewatch.sources import rules as R


@pytest.mark.parametrize(
    "pattern, text",
    [
        ("abc", "abc"),
        (r"autorização n[oº] \d+", "autorização n"),
        (r"abc?def", "def"),
        (r"ab+cd", "ab"),
        (r"a{2}bcd", "bcd"),
        (r"a\.bc\d", "a.bc"),
        (r"(abc)?de", "de"),
        (r"(x(y)z)ab", ""),
        (r"ab|cde", ""),
        (r"^ab.cde$", "cde"),
        (r"\w+", ""),
        (r"[abc]xyz*", "xy"),
        (r"ab\(cd", "ab(cd"),
        (r"abx??cdef", "cdef"),
        (r"(?:abcdef){0,1}g", "g"),
        (r"\[ab]c", "c"),
    ],
)
def test_required_text(spark, pattern, text):
    frame = spark.createDataFrame([(pattern,)], "p string")
    got = frame.select(needles.required_text(F.col("p"))).first()[0]
    assert got == text


LINES = [
    "A Portaria nº 5 foi publicada", "PORTARIA Nº 77", "autorização no 12 e nº 3", "AUTORIZAÇÃO Nº 4", "", "x", "ab", "a.b",
    "MAİS meſmo ıda", "mais mesmo ida", "ΑΣ ΑΣΒ ας", "straße STRASSE", "😀😀 ab😀", "aaaa", "tabs\there", "n\\d+ literal",
]
PATTERNS = (r"re:portaria n[ºo°]\s*\d+", r"re:autorização n[oº] \d", r"re:^a\W", r"re:mesmo|x", r"re:MAIS", r"re:ας\b", r"re:a{3}")
PLAIN = ("a", "ab", "aa", "portaria nº", "ας", "n\\d+", "😀 ", "😀😀", "mais", "not there", "STRASSE", "\there")


def lines_frame(spark, lines, sections=("DO1",)):
    rows = [(f"f{i}", sections[i % len(sections)], None, 1, 0, t) for i, t in enumerate(lines)]
    return spark.createDataFrame(
        rows, "file_name string, secao string, edition_date date, n_lines bigint, line_no bigint, line string"
    )


def wanted(lines, keywords):
    found = set()
    for i, line in enumerate(lines):
        for k in keywords:
            if k.startswith("re:"):
                hit = re.search(k[3:].replace(r"\b", r"(?!\w)"), line, re.IGNORECASE)
            else:
                hit = k.lower() in line.lower()
            if hit:
                found.add((f"f{i}", k))
    return found


def test_patterns_and_texts(spark):
    rules = R.rules_frame(spark, [R.FilterRule("r", "DO1", "", PATTERNS + PLAIN)])
    got = A.keyword_lines(lines_frame(spark, LINES), rules).collect()
    assert {(r.file_name, r.keyword) for r in got} == wanted(LINES, PATTERNS + PLAIN)


def test_the_index_finds_what_the_broadcast_finds(spark, monkeypatch):
    draw = random.Random(4)
    lines = LINES + ["".join(draw.choice("abİ é.😀") for _ in range(draw.randint(0, 30))) for _ in range(150)]
    rules = [
        R.FilterRule(f"r{i}", draw.choice(["DO1", "DO2"]), draw.choice(["", "ab", "é", "none"]), tuple(
            draw.choice(PATTERNS + PLAIN) if draw.random() < 0.3 else "".join(draw.choice("ab é.") for _ in range(draw.randint(1, 7))) + "b"
            for _ in range(4)
        ))
        for i in range(25)
    ]
    frame, table = lines_frame(spark, lines, ("DO1", "DO2", "DO3")), R.rules_frame(spark, rules)
    columns = ["file_name", "line_no", "title", "filter_ord", "keyword_ord"]

    def both():
        hits = A.keyword_lines(frame, table).select("file_name", "line_no", "filter_ord", "keyword_ord").collect()
        marked = A.marked_lines(frame, table).where("filter_ord IS NOT NULL").select(*columns).collect()
        gate = A.organisation_gate(frame, table).collect()
        return [sorted(map(repr, rows)) for rows in (hits, marked, gate)]

    small = both()
    monkeypatch.setattr(sizing, "BROADCAST_ROWS", 1)
    large = both()
    assert large == small and len(small[0]) > 200
    plan = A.keyword_lines(frame, table)._jdf.queryExecution().optimizedPlan().toString()
    assert "secao" in plan and "_gram" in plan and "Cross" not in plan


def test_the_index_folds_a_line_once_and_cuts_the_letters_of_needles(spark, monkeypatch):
    monkeypatch.setattr(sizing, "BROADCAST_ROWS", 1)
    lines = [*LINES, "item 17 of 1", "17", "é1é17😀"]
    rules = R.rules_frame(spark, [R.FilterRule(f"r{i}", "DO1", "", (*PLAIN, *PATTERNS, "1", "17", "é1", "of 1", "İ")) for i in range(2)])
    for most in (needles.LETTERS, 1):  # a class of letters, and any letter
        monkeypatch.setattr(needles, "LETTERS", most)
        found = A.keyword_lines(lines_frame(spark, lines), rules)
        got = [(r.file_name, r.filter_ord, r.keyword) for r in found.collect()]
        assert len(got) == len(set(got))
        expected = wanted([line.lower() for line in lines], [k for k in (*PLAIN, "1", "17", "é1", "of 1")])
        assert {(f, k) for f, i, k in got if i == 0 and not k.startswith("re:") and k != "İ"} == expected
        assert {(f, k) for f, i, k in got if i == 0} == {(f, k) for f, i, k in got if i == 1}
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "Contains(_loose" in plan
    filed = spark.createDataFrame([("17", 2), ("é1", 2), ("of 1", 4)], "_filed string, _size int")
    assert needles._letters(filed) == {2: ".", 4: "."}
    monkeypatch.setattr(needles, "LETTERS", 9)
    assert needles._letters(filed) == {2: r"[\x{31}\x{37}\x{e9}]", 4: r"[\x{20}\x{31}\x{66}\x{6f}]"}


def exchanged(plan):
    """Names of the columns that go through each exchange of a physical plan."""
    children = [plan.children().apply(i) for i in range(plan.children().size())]
    own = [{plan.output().apply(i).name() for i in range(plan.output().size())}] if plan.nodeName() == "Exchange" else []
    return own + [e for c in children for e in exchanged(c)]


def test_lines_meet_the_index_without_their_text(spark, monkeypatch):
    monkeypatch.setattr(sizing, "BROADCAST_ROWS", 1)
    rules = R.rules_frame(spark, [R.FilterRule(f"r{i}", "DO1", "", ("a", "ab", "portaria nº", "STRASSE", "not there")) for i in range(2)])
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        found = A.keyword_lines(lines_frame(spark, LINES), rules).select("file_name", "line_no", "filter_ord", "keyword")
        sent = exchanged(found._jdf.queryExecution().executedPlan())
        assert sum("line_no" in columns for columns in sent) == 1
        assert not any(columns & {"line", "_folded", "_loose", "_padded", "_window"} for columns in sent)
        plain = ("a", "ab", "portaria nº", "STRASSE")
        assert {(r.file_name, r.keyword) for r in found.collect()} == wanted(LINES, plain)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("edge, filters", [(1, True), (2, False), (8, False)])
def test_stretches_tell_needles_apart(spark, monkeypatch, edge, filters):
    """Also where filters let everything pass, all pieces share one list, and needles outgrow their stretches."""
    monkeypatch.setattr(sizing, "BROADCAST_ROWS", 1)
    monkeypatch.setattr(needles, "EDGE", edge)
    if not filters:
        monkeypatch.setattr(needles, "BUCKETS", 1)
        monkeypatch.setattr(bloom, "may_be_in", lambda rows, *_: rows)
    draw = random.Random(edge)
    lines = ["".join(draw.choice("ab?😀") for _ in range(draw.randint(0, 40))) for _ in range(60)]
    lines += [lines[0], "ab" * 30, "b" + "ab" * 9, "a" * 25, "😀" * 9 + "?" * 9, "abab\nabab", "xabababab"]
    words = {"".join(draw.choice("ab?😀") for _ in range(draw.randint(1, 6))) for _ in range(60)}
    words |= {"ab" * n for n in range(1, 14)} | {"a" * n for n in range(1, 14)} | {"babab", "?😀😀😀😀", "😀????", "xabab", "re:abab", "re:[ab]b?aba?"}
    rules = R.rules_frame(spark, [R.FilterRule("r", "DO1", "", tuple(sorted(words)))])
    frame = lines_frame(spark, lines)
    found = A.keyword_lines(frame.unionByName(frame), rules).select("file_name", "keyword").collect()
    got = sorted((r.file_name, r.keyword) for r in found)
    assert got == sorted([*wanted(lines, words)] * 2)


def test_blank_patterns_are_refused(spark):
    with pytest.raises(Exception, match="multi-line needle"):
        R.rules_frame(spark, [R.FilterRule("r", "DO1", "", ("re: ",))]).collect()


@pytest.mark.parametrize("n_keys, blocks", [(0, 1), (10, 1), (3000, 2), (3000, 1)])
def test_bloom_filters_keep_what_they_hold(spark, n_keys, blocks):
    held = spark.range(n_keys).select(F.xxhash64("id").alias("k"))
    every = spark.range(20_000).select("id")
    blooms = bloom.bloom_filter(held, F.col("k"), blocks)
    passed = {r.id for r in bloom.may_be_in(every, F.xxhash64("id"), blooms, blocks).collect()}
    assert passed >= set(range(n_keys))
    assert len(passed) <= n_keys + 20_000 * (0.05 if blocks == bloom.blocks_for(n_keys) else 0.3)


def test_bloom_filters_are_bounded():
    assert bloom.blocks_for(10**12) == bloom.MAX_BLOCKS
