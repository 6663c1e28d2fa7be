import re
import sys
import unicodedata

import pytest
from pyspark.sql import functions as F

from gazewatch import fixed
from gazewatch.functions import text as X
from gazewatch.operators import acts as A

TITLES = [
    "PORTARIA ANTT Nº 5, DE 10 DE JANEIRO DE 2025",
    "PORTARIA Nº 5, DE 10 DE JANEIRO DE 2025",
    "portaria sufer no 12 de 1 de março de 2024 e mais",
    "DECISÃO SUROD N° 7 de 2023; PORTARIA ANTT Nº 5 de 2025",
    "PORTARIA ANTT Nº 5 de 2025; DECISÃO SUROD N° 7 de 2023",
    "DELIBERAÇÃO DG Nº 12345",
    "DELIBERAÇÃO DG Nº 123 sem ano",
    "INSTRUÇÃO NORMATIVA SÚFER Nº 3, DE 02 DE MARÇO DE 2022",
    "INSTRUÇÃO NORMATIVA SUFER Nº 3 de 2022",
    "retificação da portaria publicada em 5 DE MAIO DE 2021",
    "RETIFICAÇÃO\r 2021",
    "RETIFICAÇÃO   2021",
    "PORTARIA\x1cANTT Nº 5 de 2025",
    "  \t PORTARIA ANTT Nº 5 de 2025 \x1f",
    "PORTARİA ANTT Nº 5 de 2025",
    "DECIſÃO SUROD Nº 7 de 2023",
    "ınstrução normativa sufer nº 3 de 2020",
    "PORTARIA ANTT Nº ٥ de ٢٠٢٥",
    "portaria e deliberação",
    "",
    "xxPORTARIA ANTT Nº 5/2025yy",
]


def lines_frame(spark, lines, n_lines=None):
    rows = [("f", "DO1", None, n_lines or len(lines), i, line) for i, line in enumerate(lines)]
    return spark.createDataFrame(
        rows, "file_name string, secao string, edition_date date, n_lines long, line_no long, line string"
    )


def test_titles_equal_python(spark):
    patterns = [re.compile(f"({p})", re.IGNORECASE) for p in fixed.TITLE_PATTERNS]

    def expected(line):
        for pattern in patterns:
            found = pattern.search(line.strip())
            if found:
                return found.group(1).strip()
        return None

    lines = ["filler", *TITLES]
    got = {r.line_no: r.title for r in A.with_titles(lines_frame(spark, lines)).collect()}
    assert got == {i: expected(line) for i, line in enumerate(lines)}
    assert sum(t is not None for t in got.values()) >= 14


def test_first_line_is_never_a_title(spark):
    got = A.with_titles(lines_frame(spark, [TITLES[0], TITLES[0]])).orderBy("line_no").collect()
    assert got[0].title is None and got[1].title is not None


def test_own_patterns_need_no_stems(spark):
    got = A.with_titles(lines_frame(spark, ["x", "EDITAL 7"]), (r"EDITAL \d+",)).collect()
    assert {r.title for r in got} == {None, "EDITAL 7"}


def test_title_date(spark):
    rows = [(t,) for t in TITLES]
    got = spark.createDataFrame(rows, "t string").select("t", X.title_date(F.col("t")).alias("d"))
    date = re.compile(f"({fixed.DATE_PHRASE})", re.IGNORECASE)
    for row in got.collect():
        found = date.search(row.t)
        assert row.d == (found.group(1) if found else "")


def test_white_space_is_what_python_strips():
    everything = {chr(c) for c in range(sys.maxunicode + 1) if chr(c).isspace()}
    assert set(fixed.WHITE_SPACE) == everything
    spelled = re.compile(X.SPACE.replace("\\x{", "\\u{").replace("\\u{85}", "\\x85").replace("\\u{a0}", "\\xa0")
                         .replace("{", "").replace("}", ""))
    assert {c for c in everything if spelled.match(c)} == everything


def test_word_class_is_what_python_calls_a_word():
    word = re.compile(r"\w")
    differing = [
        c
        for c in map(chr, range(sys.maxunicode + 1))
        if (unicodedata.category(c)[0] in "LN" or c == "_") != bool(word.match(c))
    ]
    assert differing == []


@pytest.mark.parametrize(
    "markup",
    [
        "<p>a</p><p>b</p>",
        " <xml>\n a b\x1cc </xml>\n",
        "<script>var t = 1;</script>&amp; < 3 >",
        "<p\nclass='x'>a</p",
        "<>",
        "",
    ],
)
def test_markup(spark, markup):
    expected = re.sub(r"\s+", " ", re.sub(r"<[^>]+>", " ", markup)).strip()
    got = spark.createDataFrame([(markup,)], "m string").select(X.strip_markup(F.col("m"))).first()[0]
    assert got == expected


@pytest.mark.parametrize("position", [0, 5, 249, 250, 251, 600, 899])
def test_context_snippet(spark, position):
    text = "".join(chr(97 + i % 26) for i in range(900))
    frame = spark.createDataFrame([(text, position)], "t string, p long")
    got = frame.select(X.context_snippet(F.col("t"), F.col("p"))).first()[0]
    assert got == text[max(0, position - 250) : position + 250]


@pytest.mark.parametrize("keyword", ["aa", "a", "aba", "A.", r"\E", "[x]"])
def test_overlapping_occurrences(spark, keyword):
    from gazewatch.sources.documents import occurrences

    texts = ["", "aaaa", "xaabaaba", "ABABAba", "a.a.A.b", r"\E\E q\e", "[x][X]", "aa"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    expected = {
        (i, p)
        for i, t in enumerate(texts)
        for p in range(len(t))
        if t.lower().startswith(keyword.lower(), p)
    }
    got = {(r.id, r.position) for r in occurrences(docs, keyword).collect()}
    assert got == expected
    counts = docs.select("id", X.keyword_count(F.col("text"), keyword).alias("n")).collect()
    assert {r.id: r.n for r in counts} == {
        i: sum(e[0] == i for e in expected) for i in range(len(texts))
    }


def test_occurrences_belong_to_their_row(spark):
    """Rows that share an id do not mix, and a letter that grows when folded moves nothing."""
    from gazewatch.sources.documents import line_offsets, occurrences

    texts = ["a enen b", "xxxxx enen", "İİİ\nenen", "enİEN\nİ enen ENEN", "İ", "", None, "enen" * 700]
    docs = spark.createDataFrame([(2, t) for t in texts], "id int, text string")
    got = sorted((r.text, r.position, r.line_no, r.text[r.position : r.position + 4].lower()) for r in occurrences(docs, "enen").collect())
    want = sorted(
        (t, p, t[:p].count("\n"), "enen")
        for t in texts
        if t
        for p in range(len(t))
        if t[p : p + 4].lower() == "enen"
    )
    assert got == want
    found = sorted((r.line_no, r.n_chars, r.line_offset) for r in line_offsets(docs, "id").collect())
    lines = [t.split("\n") for t in texts if t is not None]
    assert found == sorted((i, len(x), sum(len(y) + 1 for y in ls[:i])) for ls in lines for i, x in enumerate(ls))


@pytest.mark.parametrize("size", [0, 1, 255, 256, 257, 1000])
def test_sums_before(spark, size):
    from gazewatch.functions.arrays import sums_before

    numbers = [i * 7 % 11 for i in range(size)]
    frame = spark.createDataFrame([(numbers,)], "n array<bigint>")
    assert frame.select(sums_before(F.col("n"))).first()[0] == [sum(numbers[:i]) for i in range(size)]
