import time
import uuid
from datetime import date, datetime, timezone

import pytest
from pyspark.sql import functions as F

import brute
import editions
from gazewatch.plans import runs
from gazewatch.plans.runs import Settings, backfill, run
from gazewatch.sinks.tables import Tables, with_ids
from gazewatch.sources.listing import stored_files
from gazewatch.sources.rules import FilterRule, rules_frame
from gazewatch.streaming import monitor as M

ORG = editions.ORG
RULES = (
    FilterRule("sufer", "DO1", ORG, ("SUFER",)),
    FilterRule("portarias", "DO1", "", ("PORTARIA", "revoga")),
    FilterRule("secao2", "DO2", ORG, ("nomeia",)),
)
ACTS = [
    "Abertura",
    f"PORTARIA ANTT Nº 5, DE 10 DE JANEIRO DE 2025 {ORG} resolve",
    "A SUFER revoga a norma",
    "DECISÃO SUROD Nº 7, DE 9 DE JANEIRO DE 2025",
    "A SUFER decide",
]
DAY = date(2025, 1, 10)
QUIET = datetime(2025, 1, 11, 13, 8, tzinfo=timezone.utc)


@pytest.fixture
def tables(spark, tmp_path):
    return Tables(spark, str(tmp_path / "tables"), f"gazette_{uuid.uuid4().hex}").create()


@pytest.fixture
def folder(tmp_path):
    place = tmp_path / "incoming"
    place.mkdir()
    return place


def expected(texts, secao="DO1", rules=RULES):
    text = editions.text_of(texts)
    return sorted(
        (r.nome, m[0], m[2], m[5])
        for r in rules
        if r.secao == secao
        for m in brute.matches(text, r.orgao, r.keywords)
    )


def stored(tables, file=None):
    rows = tables.read("matches").collect()
    return sorted(
        (r.filter_name, r.keyword_hit, r.publication_title, r.full_text)
        for r in rows
        if file in (None, r.source_file)
    )


def go(spark, folder, tables, target=DAY, **options):
    options.setdefault("moment", QUIET)
    return run(spark, stored_files(spark, str(folder)), tables, rules_frame(spark, RULES), target, **options)


def test_a_run_from_archives_to_tables(spark, folder, tables):
    editions.archive(folder, "2025-01-10-DO1.zip", ACTS)
    editions.archive(folder, "2025-01-08-DO1E.zip", ["nada"])
    editions.archive(folder, "2025-01-07-DO1.zip", ACTS)  # before the window
    editions.archive(folder, "2025-01-10-DO3.zip", ACTS)  # no rule watches this section
    outcome = go(spark, folder, tables)
    assert stored(tables) == expected(ACTS) and len(stored(tables)) == outcome.matches > 3
    assert {r.file_name for r in tables.read("processed_files").collect()} == {
        "2025-01-10-DO1.zip",
        "2025-01-08-DO1E.zip",
    }
    (row,) = tables.read("runs").collect()
    assert (row.run_date, row.files_processed, row.matches_found, row.email_sent) == (
        DAY, 2, outcome.matches, 1,
    )
    assert row.notes == "Lookback: 2 dias, 2 arquivo(s) processado(s)"
    (mail,) = tables.read("digests").collect()
    assert mail.subject == f"[DOU] 2025-01-10 — {outcome.matches} achado(s)"
    items = tables.read("digest_items").orderBy("n").collect()
    assert [r.n for r in items] == list(range(1, outcome.matches + 1)) and mail.n_matches == outcome.matches
    assert all(f"<h3>Achado #{r.n} — " in r.block for r in items)

    assert sorted(r.id for r in tables.read("matches").collect()) == list(range(1, 1 + outcome.matches))
    ids = with_ids(tables.read("matches").drop("id"), 40)
    assert sorted(r.id for r in ids.collect()) == list(range(41, 41 + outcome.matches))
    assert spark.sql(f"SELECT count(*) FROM {tables.database}.matches").first()[0] == outcome.matches


def test_later_runs_see_only_new_files(spark, folder, tables):
    editions.archive(folder, "2025-01-10-DO1.zip", ACTS)
    first = go(spark, folder, tables, run_id="a")
    assert go(spark, folder, tables, run_id="b").files == 0
    editions.archive(folder, "2025-01-10-DO1E.zip", ACTS)
    last = go(spark, folder, tables, date(2025, 1, 12), run_id="c")
    assert (last.files, last.matches) == (1, first.matches)
    assert tables.read("matches").count() == 2 * first.matches


def test_a_repeated_run_replaces_itself(spark, folder, tables, monkeypatch):
    editions.archive(folder, "2025-01-10-DO1.zip", ACTS)

    def crash(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as broken:
        broken.setattr(Tables, "put_processed", crash)
        with pytest.raises(RuntimeError, match="lost"):
            go(spark, folder, tables, run_id="a")
    assert tables.read("processed_files").count() == 0
    assert stored(tables) == []  # not valid before the ledger has the file
    for _ in range(2):
        outcome = go(spark, folder, tables, run_id="a")
        assert outcome.files == 1 and stored(tables) == expected(ACTS)
        assert tables.read("processed_files").count() == 1
        assert tables.read("runs").count() == tables.read("digests").count() == 1


def test_broken_files_are_set_aside_and_tried_again(spark, folder, tables):
    editions.archive(folder, "2025-01-10-DO1.zip", ACTS)
    editions.broken(folder, "2025-01-09-DO1.zip")
    assert go(spark, folder, tables, run_id="a").files == 1
    (bad,) = tables.read("quarantine").collect()
    assert bad.file_name == "2025-01-09-DO1.zip" and "BadZipFile" in bad.err
    editions.archive(folder, "2025-01-09-DO1.zip", ACTS)
    assert go(spark, folder, tables, run_id="b").files == 1
    assert tables.read("processed_files").count() == 2
    assert tables.read("quarantine").count() == 0


def state(tables):
    return {
        "ledger": sorted(r.file_name for r in tables.read("processed_files").collect()),
        "quarantine": sorted(r.file_name for r in tables.read("quarantine").collect()),
        "runs": [(r.files_processed, r.matches_found) for r in tables.read("runs").collect()],
        "digests": tables.read("digests").count(),
        "matches": tables.read("matches").count(),
    }


def test_a_repeat_replaces_all_that_a_run_wrote(spark, folder, tables):
    """The file is broken, then repaired, then has no hit, then is broken again."""
    editions.broken(folder, "2025-01-10-DO1.zip")
    go(spark, folder, tables, run_id="a/1 x")
    want = dict(ledger=[], quarantine=["2025-01-10-DO1.zip"], runs=[(0, 0)], digests=0, matches=0)
    assert state(tables) == want
    editions.archive(folder, "2025-01-10-DO1.zip", ACTS)
    n = go(spark, folder, tables, run_id="a/1 x").matches
    assert n and state(tables) == dict(ledger=["2025-01-10-DO1.zip"], quarantine=[], runs=[(1, n)], digests=1, matches=n)
    editions.archive(folder, "2025-01-10-DO1.zip", ["nada"])
    go(spark, folder, tables, run_id="a/1 x")
    assert state(tables) == dict(ledger=["2025-01-10-DO1.zip"], quarantine=[], runs=[(1, 0)], digests=0, matches=0)
    editions.broken(folder, "2025-01-10-DO1.zip")
    go(spark, folder, tables, run_id="a/1 x")
    assert state(tables) == want


def test_a_crash_before_the_ledger_duplicates_nothing(spark, folder, tables, monkeypatch):
    editions.archive(folder, "2025-01-10-DO1.zip", ACTS)

    def crash(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as broken:
        broken.setattr(Tables, "put_processed", crash)
        with pytest.raises(RuntimeError, match="lost"):
            go(spark, folder, tables, run_id="a")
    assert go(spark, folder, tables, run_id="b").files == 1
    assert stored(tables) == expected(ACTS)
    assert tables.read("runs").count() == tables.read("digests").count() == 1


def test_nothing_is_left_of_the_work_of_a_run(spark, folder, tables, tmp_path):
    editions.archive(folder, "2025-01-10-DO1.zip", ACTS)
    go(spark, folder, tables)
    assert [p for p in (tmp_path / "tables" / "_work").glob("*")] == []


def test_signed_pdfs_only_without_an_archive(spark, folder, tables):
    editions.archive(folder, "2025-01-10-DO1.zip", ["nada"])
    for name in ("2025_01_10_ASSINADO_do1.pdf", "2025_01_09_ASSINADO_do1.pdf", "2025_01_10_ASSINADO_do2.pdf"):
        editions.broken(folder, name, b"%PDF")
    pages = [("2025_01_09_ASSINADO_do1.pdf", i, f" {t}\n") for i, t in enumerate(ACTS)]
    text = spark.createDataFrame(pages, "file_name string, page_no long, text string")
    outcome = go(spark, folder, tables, page_text=text)
    assert outcome.files == 2
    assert stored(tables) == expected(ACTS)
    assert [(r.file_name, r.err) for r in tables.read("quarantine").collect()] == [
        ("2025_01_10_ASSINADO_do2.pdf", "no page text")
    ]


def test_first_filter_claims_a_file(spark, folder, tables):
    editions.archive(folder, "2025-01-10-DO1.zip", ACTS)
    go(spark, folder, tables, settings=Settings(claim="first_filter"))
    assert stored(tables) == expected(ACTS, rules=RULES[:1])


@pytest.mark.parametrize(
    "moment, texts, subject",
    [
        (datetime(2025, 1, 6, 10, 8, tzinfo=timezone.utc), ["nada"], "Sistema operacional (0 achados)"),
        (datetime(2025, 1, 7, 16, 8, tzinfo=timezone.utc), ACTS, "achado(s)"),
        (datetime(2025, 1, 11, 13, 8, tzinfo=timezone.utc), ["nada"], None),
        (datetime(2025, 1, 12, 13, 8, tzinfo=timezone.utc), ACTS, "achado(s)"),
        (datetime(2025, 1, 7, 13, 8, tzinfo=timezone.utc), ["nada"], None),
    ],
)
def test_when_a_digest_goes_out(spark, folder, tables, moment, texts, subject):
    editions.archive(folder, "2025-01-10-DO1.zip", texts)
    go(spark, folder, tables, moment=moment)
    mails = tables.read("digests").collect()
    assert [m.subject.endswith(subject) for m in mails] == ([True] if subject else [])
    assert tables.read("runs").first().email_sent == len(mails)


def test_backfill_of_a_range(spark, folder, tables):
    for day in (8, 10, 12):
        editions.archive(folder, f"2025-01-{day:02}-DO1.zip", ACTS if day != 8 else ["nada"])
    files = stored_files(spark, str(folder))
    rules = rules_frame(spark, RULES)
    outcome = backfill(spark, files, tables, rules, date(2025, 1, 8), date(2025, 1, 11))
    per_day = len(expected(ACTS))
    assert (outcome.files, outcome.matches) == (2, per_day)
    rows = tables.read("runs").orderBy("run_date").collect()
    assert [(r.run_date.day, r.files_processed, r.matches_found) for r in rows] == [
        (8, 1, 0), (9, 0, 0), (10, 1, per_day), (11, 0, 0),
    ]
    assert {r.email_sent for r in rows} == {0} and tables.read("digests").count() == 0
    assert rows[0].notes == "Sem lookback (backfill), 1 arquivo(s) processado(s)"
    assert go(spark, folder, tables, date(2025, 1, 12)).files == 1  # the ledger is shared
    again = backfill(spark, files, tables, rules, date(2025, 1, 8), date(2025, 1, 11))
    assert (again.files, again.matches) == (0, 0) and tables.read("matches").count() == 2 * per_day
    nothing = backfill(spark, files, tables, rules, date(2025, 1, 5), date(2025, 1, 4))
    assert (nothing.files, nothing.matches) == (0, 0)


def test_a_digest_holds_everything(spark):
    from gazewatch.operators import digest as G

    rows = [
        (DAY, i % 2, "r", DAY, f"f{i % 3}", i % 2, "k", i, "" if i == 4 else f"T{i}", "" if i % 2 else "D", f"s{i}")
        for i in range(11)
    ]
    frame = spark.createDataFrame(
        rows,
        "run_date date, filter_ord int, filter_name string, edition_date date, source_file string, keyword_ord int, "
        "keyword_hit string, line_no long, publication_title string, publication_date string, text_snippet string",
    )
    numbered = G.numbered(frame)
    (message,) = G.digest(numbered, "[X]", "DO1").collect()
    items = G.digest_items(numbered).orderBy("n").collect()
    body = message.head + "".join(r.block for r in items) + message.foot
    assert [body.index(f"Achado #{i} ") for i in range(1, 12)] == sorted(
        body.index(f"Achado #{i} ") for i in range(1, 12)
    )
    assert "Sem título identificado — D" in body and "Total de achados: 11" in body
    ordered = sorted(rows, key=lambda r: (r[1], r[3], r[4], r[5], r[7]))
    assert [r.text_snippet for r in numbered.orderBy("n").collect()] == [r[10] for r in ordered]


def watch(spark, folder, tables, tmp_path, **options):
    query = M.monitor(
        spark, str(folder), tables, rules_frame(spark, RULES), str(tmp_path / "checkpoint"),
        clock=lambda: QUIET, **options,
    )
    query.awaitTermination()
    return query


def test_monitoring_picks_up_new_files_once(spark, folder, tables, tmp_path):
    editions.archive(folder, "2025-01-10-DO1.zip", ACTS)
    editions.broken(folder, "2025-01-10-DO2.zip")
    watch(spark, folder, tables, tmp_path)
    assert stored(tables) == expected(ACTS)
    assert [r.file_name for r in tables.read("quarantine").collect()] == ["2025-01-10-DO2.zip"]
    watch(spark, folder, tables, tmp_path)  # nothing new: a run row all the same
    assert sorted(r.files_processed for r in tables.read("runs").collect()) == [0, 1]
    editions.archive(folder, "2025-01-08-DO1E.zip", ACTS)  # a late extra edition
    editions.broken(folder, "2025_01_10_ASSINADO_do1.pdf")  # hidden by the archive seen before
    watch(spark, folder, tables, tmp_path)
    assert tables.read("runs").count() == 3
    assert stored(tables, "2025-01-08-DO1E.zip") == expected(ACTS)
    assert tables.read("matches").count() == 2 * len(expected(ACTS))
    assert {r.file_name for r in tables.read("quarantine").collect()} == {"2025-01-10-DO2.zip"}
    editions.archive(folder, "2025-01-10-DO2.zip", [f"{ORG} nomeia"])  # repaired, and tried again
    watch(spark, folder, tables, tmp_path)
    assert tables.read("quarantine").count() == 0
    assert stored(tables, "2025-01-10-DO2.zip") == expected([f"{ORG} nomeia"], "DO2")


def test_the_heartbeat_of_a_quiet_morning(spark, folder, tables, tmp_path):
    morning = datetime(2025, 1, 6, 10, 8, tzinfo=timezone.utc)
    editions.archive(folder, "2025-01-06-DO1.zip", ["nada"])
    for n in (1, 2):
        M.monitor(
            spark, str(folder), tables, rules_frame(spark, RULES), str(tmp_path / "checkpoint"), clock=lambda: morning
        )
        assert tables.read("runs").count() == tables.read("digests").count() == n


@pytest.mark.parametrize("size", [1, None])
def test_the_size_of_batches_changes_nothing(spark, folder, tables, tmp_path, size):
    editions.broken(folder, "2025_01_10_ASSINADO_do1.pdf")
    editions.archive(folder, "2025-01-10-DO1.zip", ACTS)
    editions.broken(folder, "2025_01_09_ASSINADO_do1.pdf")  # hidden by a broken archive
    editions.broken(folder, "2025-01-09-DO1.zip")
    pages = [(f"2025_01_{d}_ASSINADO_do1.pdf", i, t) for d in ("09", "10") for i, t in enumerate(ACTS)]
    text = spark.createDataFrame(pages, "file_name string, page_no long, text string")
    watch(spark, folder, tables, tmp_path, page_text=text, files_per_batch=size)
    assert stored(tables) == expected(ACTS)
    assert [r.file_name for r in tables.read("processed_files").collect()] == ["2025-01-10-DO1.zip"]
    assert {r.file_name for r in tables.read("quarantine").collect()} == {"2025-01-09-DO1.zip"}


def test_a_failed_batch_is_repeated(spark, folder, tables, tmp_path, monkeypatch):
    editions.archive(folder, "2025-01-10-DO1.zip", ACTS)

    def crash(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as broken:
        broken.setattr(runs.Tables, "put_run", crash)
        with pytest.raises(Exception, match="lost"):
            watch(spark, folder, tables, tmp_path)
    assert tables.read("processed_files").count() == 1
    watch(spark, folder, tables, tmp_path)
    assert stored(tables) == expected(ACTS)
    assert tables.read("processed_files").count() == tables.read("runs").count() == 1


def test_repeats_are_dropped_by_the_stream_and_then_by_the_ledger(spark, folder, tables, tmp_path):
    def again(where):
        editions.archive(folder / where, "2025-01-10-DO1.zip", ACTS)

    def state_of(query):
        return query.lastProgress["stateOperators"][0]

    editions.archive(folder, "2025-01-10-DO1.zip", ACTS)
    watch(spark, folder, tables, tmp_path)
    again("resent")  # inside the watermark
    query = watch(spark, folder, tables, tmp_path)
    assert state_of(query)["numRowsTotal"] == 1
    assert sorted(r.files_processed for r in tables.read("runs").collect()) == [0, 1]
    assert stored(tables) == expected(ACTS)
    editions.archive(folder, "2019-03-01-DO1.zip", ACTS)  # an edition of years ago is not late
    query = watch(spark, folder, tables, tmp_path)
    assert state_of(query)["numRowsDroppedByWatermark"] == 0
    assert stored(tables, "2019-03-01-DO1.zip") == expected(ACTS)


def test_a_repeat_beyond_the_watermark(spark, folder, tables, tmp_path):
    names = ("2025-01-10-DO1.zip", "2025-01-10-DO1E.zip", "2025-01-11-DO1.zip")
    for name in names:  # time passes between the calls, and the stream forgets
        editions.archive(folder, name, ACTS)
        query = watch(spark, folder, tables, tmp_path, remember="1 second")
        time.sleep(2)
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] < len(names)
    editions.archive(folder / "resent", names[0], ACTS)
    watch(spark, folder, tables, tmp_path, remember="1 second")
    assert tables.read("matches").count() == len(names) * len(expected(ACTS))
    assert tables.read("processed_files").count() == len(names)


def test_ledger_keeps_the_first_row(spark, tables):
    files = [("a.zip", date(2025, 1, 2)), ("a.zip", date(2025, 1, 1)), ("b.zip", date(2025, 1, 3))]
    frame = spark.createDataFrame(files, "file_name string, edition_date date")
    assert tables.put_processed(frame, "one") == 2
    assert tables.put_processed(frame.withColumn("edition_date", F.lit(date(2026, 1, 1))), "two") == 0
    got = {r.file_name: r.processed_date for r in tables.read("processed_files").collect()}
    assert got == {"a.zip": date(2025, 1, 1), "b.zip": date(2025, 1, 3)}


def test_ids_are_never_given_twice(spark, folder, tables, monkeypatch):
    editions.archive(folder, "2025-01-10-DO1.zip", ACTS)
    n = len(expected(ACTS))

    def crash(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as broken:
        broken.setattr(Tables, "put_processed", crash)
        with pytest.raises(RuntimeError, match="lost"):
            go(spark, folder, tables, run_id="a")
    lost = {r.id for r in tables.written("matches").collect()}
    assert lost == set(range(1, n + 1))
    go(spark, folder, tables, run_id="b")
    first = {r.id for r in tables.read("matches").collect()}
    go(spark, folder, tables, run_id="b")  # repeated
    again = {r.id for r in tables.read("matches").collect()}
    assert len(first) == len(again) == n and not lost & first and not first & again
    editions.archive(folder, "2025-01-10-DO1E.zip", ACTS)
    go(spark, folder, tables, run_id="c")
    ids = [r.id for r in tables.read("matches").collect()]
    assert len(ids) == len(set(ids)) == 2 * n
    runs_ = [r.id for r in tables.read("runs").collect()]
    assert len(runs_) == len(set(runs_)) == 2


def test_two_writers_take_different_ranges(spark, tmp_path):
    from gazewatch.sinks import ids

    folder = str(tmp_path / "ids")
    assert [ids.reserve(spark, folder, n, "r") for n in (5, 0, 3, 1)] == [1, 6, 6, 9]
    (tmp_path / "ids" / "000000000004").write_text("12\nother\n")  # another writer was faster
    assert ids.reserve(spark, folder, 2, "r") == 13
    (tmp_path / "ids" / "000000000006").write_text("12")
    with pytest.raises(RuntimeError, match="cut short"):
        ids.reserve(spark, folder, 1, "r")


def test_sql_finds_the_tables_after_a_restart(spark, folder, tables):
    editions.archive(folder, "2025-01-10-DO1.zip", ACTS)
    go(spark, folder, tables, run_id="it's a/b")
    want = stored(tables)
    spark.sql(f"DROP DATABASE {tables.database} CASCADE")
    again = Tables(spark, tables.root, tables.database).create()
    assert stored(again) == want
    spark.sql(f"USE {tables.database}")
    try:
        rows = spark.sql("SELECT filter_name, COUNT(*) AS total FROM matches GROUP BY filter_name ORDER BY total DESC").collect()
        assert sum(r.total for r in rows) == len(want) and rows[0].total >= rows[-1].total
        recent = spark.sql("SELECT * FROM matches WHERE created_ts >= current_date() - INTERVAL 30 DAYS ORDER BY created_ts DESC")
        assert recent.count() == len(want)
        assert spark.sql("SELECT max(id) FROM runs").first()[0] == 1
    finally:
        spark.sql("USE default")


def test_days_are_put_together(spark, folder, tables, monkeypatch):
    editions.archive(folder, "2025-01-10-DO1.zip", ACTS)
    editions.archive(folder, "2025-01-09-DO1.zip", ACTS)
    go(spark, folder, tables, run_id="a")
    editions.archive(folder, "2025-01-10-DO1E.zip", ACTS)
    go(spark, folder, tables, run_id="b")
    rows = lambda: sorted(map(str, tables.read("matches").drop("created_ts").collect()))
    want = rows()
    assert tables.compact(DAY) == 1 and rows() == want
    kept = {(r.run_id, r.edition_date) for r in tables.written("matches").collect()}
    assert kept == {("a", date(2025, 1, 9))}

    # Moved into place, but nothing tidied up: readers see each match once.
    def crash(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as broken:
        broken.setattr(Tables, "_drop", crash)
        with pytest.raises(RuntimeError, match="lost"):
            tables.compact(date(2025, 1, 9))
    assert rows() == want
    again = Tables(spark, tables.root, f"{tables.database}_again").create()
    assert sorted(map(str, again.read("matches").drop("created_ts").collect())) == want
    assert tables.compact(date(2025, 1, 9)) == 2 and rows() == want
    assert tables.compact(DAY) == 2 and rows() == want

    # One day's matches come from that day's folder.
    day = tables.read("matches").where(F.col("edition_date") == F.lit(DAY))
    plan = day._jdf.queryExecution().executedPlan().toString()
    scans = [p for p in plan.split("FileScan")[1:] if "full_text" in p.split("PartitionFilters")[0]]
    assert scans and all("edition_date" in p.split("PartitionFilters")[1].split("PushedFilters")[0] for p in scans)


def test_a_run_is_repeated_after_its_days_were_put_together(spark, folder, tables):
    editions.archive(folder, "2025-01-10-DO1.zip", ACTS)
    go(spark, folder, tables, run_id="a")
    editions.archive(folder, "2025-01-10-DO1E.zip", ACTS)
    go(spark, folder, tables, run_id="b")
    tables.compact(DAY)
    want = stored(tables)
    go(spark, folder, tables, run_id="a")
    assert stored(tables) == want
    assert tables.compact(DAY) == 3 and stored(tables) == want


def test_acts_end_with_their_entry(spark, folder, tables):
    from gazewatch.plans.search import find_matches
    from gazewatch.sources.pages import page_lines

    texts = [
        "PORTARIA ANTT Nº 1, DE 10 DE JANEIRO DE 2025\nSUFER um", "SUFER dois\nfim",
        f"{ORG}\nDECISÃO SUROD Nº 7, DE 9 DE JANEIRO DE 2025\nSUFER tres", "PORTARIA ANTT Nº 2, DE 10 DE JANEIRO DE 2025",
    ]
    rows = [("f", "DO1", DAY, i, t) for i, t in enumerate(texts)]
    pages = spark.createDataFrame(rows, "file_name string, secao string, edition_date date, page_no long, text string")
    rules = rules_frame(spark, RULES[:1])
    got = {r.line_no: (r.publication_title, r.full_text) for r in find_matches(page_lines(pages, True), rules).collect()}
    assert got == {
        1: ("PORTARIA ANTT Nº 1, DE 10 DE JANEIRO DE 2025\nSUFER um".replace("\n", " "), "SUFER um"),
        3: ("SUFER dois fim", "SUFER dois\nfim"),
        8: ("DECISÃO SUROD Nº 7, DE 9 DE JANEIRO DE 2025", "DECISÃO SUROD Nº 7, DE 9 DE JANEIRO DE 2025\nSUFER tres"),
    } | {1: ("SUFER um", "SUFER um")}
    parity = find_matches(page_lines(pages), rules).collect()
    assert {r.line_no for r in parity} == {1, 3, 8} and any("dois" in r.full_text and "um" in r.full_text for r in parity)
