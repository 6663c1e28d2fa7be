import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import brute
from gazewatch.functions import sizing
from gazewatch.operators import acts as A
from gazewatch.plans import search
from gazewatch.sources.rules import FilterRule, rules_frame

RULES = (
    FilterRule("um", "DO1", "Agência Nacional", ("SUFER", "outorga de ")),
    FilterRule("dois", "DO1", "", ("portaria",)),
    FilterRule("tres", "DO2", "agência", ("sufer",)),
)
TITLES = (
    "PORTARIA ANTT Nº 5, DE 10 DE JANEIRO DE 2025",
    "  DECISÃO SUROD Nº 7 de 2023",
    "RETIFICAÇÃO da PORTARIA de 2 DE MARÇO DE 2024",
    "DELIBERAÇÃO DG Nº 12345; PORTARIA ANTT Nº 5 de 2025",
)
PLAIN = (
    "texto",
    "",
    "   ",
    "portaria Nº 3 2024",
    "a Agência Nacional resolve",
    "outorga DE ferrovia SUFER sufer",
    "xSUFERx " + "z" * 90,
    "\tSufer ",
)


def document(rng, length, density):
    lines = [
        rng.choice(TITLES) if rng.random() < density else rng.choice(PLAIN) for _ in range(length)
    ]
    if rng.random() < 0.3:
        lines[0] = rng.choice(TITLES)
    return "\n".join(lines)


def corpus(seed, sizes=(1, 3, 40, 120, 450), densities=(0.002, 0.01, 0.1)):
    rng = random.Random(seed)
    texts = [document(rng, n, d) for n in sizes for d in densities]
    return [(f"f{i}", rng.choice(["DO1", "DO2"]), None, t) for i, t in enumerate(texts)]


def documents_frame(spark, docs):
    return spark.createDataFrame(
        docs, "file_name string, secao string, edition_date date, text string"
    )


def expected(docs, rules=RULES, back=50, forward=200):
    return sorted(
        (name, rule.nome, *match)
        for name, secao, _, text in docs
        for rule in rules
        if rule.secao == secao
        for match in brute.matches(text, rule.orgao, rule.keywords, back, forward)
    )


def found(frame):
    return sorted(
        (
            r.source_file,
            r.filter_name,
            r.keyword_hit,
            r.line_no,
            r.publication_title,
            r.publication_date,
            r.text_snippet,
            r.full_text,
        )
        for r in frame.collect()
    )


@pytest.mark.parametrize("seed", [1, 2])
def test_random_documents(spark, seed):
    docs = corpus(seed)
    want = expected(docs)
    got = found(search.find_matches_in_documents(documents_frame(spark, docs), rules_frame(spark, RULES)))
    assert got == want
    assert len(want) > 200


@pytest.mark.parametrize("tile", [7, 64])
def test_tiles_make_no_difference(spark, monkeypatch, tile):
    """Files cut into many small tiles, with reaches longer and shorter than a tile."""
    monkeypatch.setattr(A, "WINDOW_TILE", tile)
    monkeypatch.setattr(A, "TEXT_TILE", tile)
    docs = corpus(3, sizes=(40, 130, 300))
    for back, forward in ((50, 200), (5, 8)):
        got = search.find_matches_in_documents(
            documents_frame(spark, docs), rules_frame(spark, RULES), back=back, forward=forward
        )
        assert found(got) == expected(docs, back=back, forward=forward)


def test_large_rule_tables_are_indexed(spark, monkeypatch):
    monkeypatch.setattr(sizing, "BROADCAST_ROWS", 1)
    docs = corpus(4, sizes=(3, 40))
    frame = search.find_matches_in_documents(documents_frame(spark, docs), rules_frame(spark, RULES))
    assert found(frame) == expected(docs)


line = st.sampled_from(TITLES + PLAIN)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(line, min_size=1, max_size=12).map("\n".join), min_size=20, max_size=40))
def test_small_documents_of_any_shape(spark, texts):
    docs = [(f"f{i}", "DO1", None, t) for i, t in enumerate(texts)]
    got = search.find_matches_in_documents(
        documents_frame(spark, docs), rules_frame(spark, RULES), back=4, forward=5
    )
    assert found(got) == expected(docs, back=4, forward=5)


def one(spark, lines, rules=(FilterRule("r", "DO1", "", ("chave",)),), **options):
    docs = [("f", "DO1", None, "\n".join(lines))]
    return found(
        search.find_matches_in_documents(
            documents_frame(spark, docs), rules_frame(spark, rules), **options
        )
    )


TITLE = TITLES[0]


def test_reach_backward_is_49_lines(spark):
    for gap, titled in ((49, True), (50, False)):
        ((*_, title, date, _, full),) = one(spark, ["x", TITLE, *["y"] * (gap - 1), "chave"])
        assert (title == TITLE) == titled
        assert (date != "") == titled
        assert full.startswith(TITLE if titled else "chave")


def test_reach_forward_is_199_lines(spark):
    for gap, closed in ((199, True), (200, False)):
        ((*_, full),) = one(spark, ["x", TITLE, "chave", *["y"] * (gap - 2), TITLES[2], "fim"])
        assert full.endswith("y" if closed else "fim")


def test_title_on_the_first_line_counts_only_as_text(spark):
    ((*_, title, date, _, full),) = one(spark, [TITLE, "chave", "z"])
    assert (title, date, full) == ("chave z", "", "chave\nz")
    ((*_, title, date, _, full),) = one(spark, [TITLE + " chave", "z"])
    assert title.startswith(TITLE) and date == "" and full.endswith("z")


def test_same_title_twice_keeps_the_first(spark):
    got = one(spark, ["x", TITLE, "chave 1", TITLE, "chave 2"])
    assert len(got) == 1 and got[0][-1] == TITLE + "\nchave 1"


def test_untitled_copies_collapse(spark):
    got = one(spark, ["chave"] + ["chave"] * 300)
    assert len(got) == len(brute.matches("\n".join(["chave"] * 301), "", ["chave"]))


def test_gate_is_per_file_and_case_insensitive(spark):
    rule = FilterRule("r", "DO1", "Órgão X", ("chave",))
    assert one(spark, ["chave", "y", "ÓRGÃO x"], (rule,))
    assert not one(spark, ["chave", "y"], (rule,))


def test_fallback_title_is_200_characters_on_one_line(spark):
    ((*_, title, _, snippet, full),) = one(spark, ["  chave", "", "a" * 400, "b" * 400])
    assert title == ("chave  " + "a" * 400)[:200]
    assert snippet == full[:500] and full.endswith("b")


def test_blank_keyword_is_refused(spark):
    for keyword in ("", " ", "a\nb"):
        with pytest.raises(Exception, match="multi-line needle"):
            rules_frame(spark, [FilterRule("r", "DO1", "", (keyword,))]).collect()
    with pytest.raises(Exception, match="multi-line needle"):
        rules_frame(spark, [FilterRule("r", "DO1", "a\nb", ("c",))]).collect()


def test_allowed_restricts_who_sees_what(spark):
    docs = corpus(5, sizes=(40,))
    lines = search.document_lines(documents_frame(spark, docs))
    allowed = spark.createDataFrame([("f0", 0), ("f1", 1), ("f2", 2)], "file_name string, filter_ord int")
    got = found(search.find_matches(lines, rules_frame(spark, RULES), allowed=allowed))
    pairs = {("f0", "um"), ("f1", "dois"), ("f2", "tres")}
    assert got == [m for m in expected(docs) if (m[0], m[1]) in pairs]


def test_one_long_file_is_spread_over_tasks(spark, monkeypatch):
    """Windows, gate and text of a single file run in many partitions."""
    monkeypatch.setattr(A, "WINDOW_TILE", 64)
    monkeypatch.setattr(A, "TEXT_TILE", 64)
    docs = [("f", "DO1", None, document(random.Random(7), 3000, 0.05))]
    lines = search.document_lines(documents_frame(spark, docs))
    rules = rules_frame(spark, RULES)
    switches = ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")
    before = {k: spark.conf.get(k) for k in switches}
    try:
        for key, value in zip(switches, ("false", "-1", "8")):
            spark.conf.set(key, value)
        hits = search.gated_hits(lines, rules)
        found_in = hits.groupBy(F.spark_partition_id().alias("p")).count().collect()
        everything = search.find_matches(lines, rules)
        written_in = everything.groupBy(F.spark_partition_id().alias("p")).count().collect()
        got = found(everything)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    for counts in (found_in, written_in):
        sizes = [r["count"] for r in counts]
        assert len(sizes) >= 6 and max(sizes) < sum(sizes) / 2
    assert got == expected(docs)


def test_tables_beyond_the_limits_are_not_broadcast(spark, monkeypatch):
    rules = rules_frame(spark, RULES)
    assert sizing.fits_broadcast(rules)
    monkeypatch.setattr(sizing, "BROADCAST_ROWS", 3)
    assert sizing.fits_broadcast(rules)
    assert not sizing.fits_broadcast(rules, F.size("keywords"))
    monkeypatch.setattr(sizing, "BROADCAST_BYTES", 10)
    assert not sizing.fits_broadcast(rules)


def test_a_cluster_must_name_the_shared_folder():
    class Session:
        def __init__(self, master, **settings):
            self.sparkContext = self
            self.conf, self.master = self, master
            self.settings = {"spark.sql.warehouse.dir": "/warehouse", **settings}

        def get(self, name, default=None):
            return self.settings.get(name, default)

        def getCheckpointDir(self):
            return None

    assert sizing.shared_folder(Session("local[4]")) == "/warehouse/_staged"
    assert sizing.shared_folder(Session("yarn", **{"spark.checkpoint.dir": "s3://b/cp/"})) == "s3://b/cp"
    for master in ("yarn", "local-cluster[3,2,1000]", "k8s://x"):
        with pytest.raises(ValueError, match="checkpoint.dir"):
            sizing.shared_folder(Session(master))
