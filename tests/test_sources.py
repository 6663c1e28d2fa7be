from datetime import date

import pytest
from pyspark.sql import functions as F

import editions
from gazewatch.operators import numbering
from gazewatch.sources import archives, documents, listing, pages
from gazewatch.sources import rules as R


def test_archive_members_become_lines(spark, tmp_path):
    texts = ["um  dois", "", "tres", " ", "quatro"]
    editions.archive(
        tmp_path, "2025-01-10-DO1.zip", texts, [("x.txt", "no"), ("bad.xml", b"a\xff<b>z</b>")]
    )
    editions.archive(tmp_path, "2025-01-10-DO2E.zip", [], [("x.txt", "no")])
    files = listing.stored_files(spark, str(tmp_path))
    entries = archives.archive_entries(files)
    lines = pages.page_lines(archives.entry_pages(entries).where("err IS NULL").drop("err"))
    got = lines.orderBy("line_no").collect()
    assert "\n".join(r.line for r in got) == editions.text_of([*texts, "a z"])
    assert [r.line_no for r in got] == list(range(len(got)))
    assert {r.n_lines for r in got} == {len(got)}
    assert {(r.file_name, r.secao, r.edition_date) for r in got} == {
        ("2025-01-10-DO1.zip", "DO1", date(2025, 1, 10))
    }


def test_members_of_a_large_archive_are_spread(spark, tmp_path, monkeypatch):
    texts = [f"ato {i}" for i in range(300)]
    editions.archive(tmp_path, "2025-01-10-DO1.zip", texts)
    monkeypatch.setattr(pages, "PAGE_TILE", 16)
    entries = archives.archive_entries(listing.stored_files(spark, str(tmp_path)), part_bytes=500)
    parts = entries.select(F.spark_partition_id().alias("p")).distinct().count()
    assert parts > 1
    lines = pages.page_lines(archives.entry_pages(entries).drop("err")).orderBy("line_no")
    assert "\n".join(r.line for r in lines.collect()) == editions.text_of(texts)


def test_broken_archives_give_an_error_row(spark, tmp_path):
    editions.broken(tmp_path, "2025-01-10-DO1.zip")
    path = editions.archive(tmp_path, "2025-01-10-DO2.zip", ["a " * 5000])
    content = bytearray(path.read_bytes())
    content[60:90] = b"\0" * 30  # the directory is fine, the member is not
    path.write_bytes(bytes(content))
    editions.archive(tmp_path, "2025-01-10-DO3.zip", ["bom"])
    rows = archives.archive_entries(listing.stored_files(spark, str(tmp_path))).collect()
    failed = {r.file_name for r in rows if r.err}
    assert failed == {"2025-01-10-DO1.zip", "2025-01-10-DO2.zip"}
    assert [r.file_name for r in rows if not r.err] == ["2025-01-10-DO3.zip"]
    assert any(r.err.startswith("BadZipFile") for r in rows if r.err)


def test_directories_are_read_once(spark, tmp_path):
    editions.archive(tmp_path, "2025-01-10-DO1.zip", ["a"])
    entries = archives.archive_entries(listing.stored_files(spark, str(tmp_path)))
    plan = entries._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInPandas") == 2 and "Union" not in plan


def test_listing_patterns(spark):
    body = """<a>2025-01-10-DO1.zip</a> 2025-01-10-DO1E.zip 2025-01-10-DO2.zip
      2025_01_10_ASSINADO_do1.pdf 2025_01_10_ASSINADO_do1_extra_A.pdf 2025-01-10-DO1.zip
      2025_01_10_ASSINADO_do1_extra_D.pdf 2025-01-10-DO1.ZIP 2025-01-10-DO11.zip x2024-12-31-DO1.zip"""
    frame = spark.createDataFrame([(date(2025, 1, 10), body)], "edition_date date, body string")
    got = listing.listed_files(frame, ["DO1"])
    assert {r.file_name for r in got.collect()} == {
        "2025-01-10-DO1.zip",
        "2025-01-10-DO1E.zip",
        "2025_01_10_ASSINADO_do1.pdf",
        "2025_01_10_ASSINADO_do1_extra_A.pdf",
        "2024-12-31-DO1.zip",
    }
    assert got.count() == 5
    assert {r.edition_date for r in got.collect()} == {date(2025, 1, 10)}


def test_attributes_come_from_the_name(spark):
    paths = [
        "file:/x/2025-01-10-DO1.zip",
        "s3a://b/y/2025-01-10-DO3E.zip",
        "2025_01_11_ASSINADO_do2_extra_B.pdf",
        "2025_01_11_ASSINADO_do2.pdf",
        "2025-13-10-DO1.zip",
        "2025-01-10-DO1.zip.tmp",
    ]
    got = listing.edition_attributes(spark.createDataFrame([(p,) for p in paths], "path string"))
    assert {(r.file_name, r.secao, str(r.edition_date)) for r in got.collect()} == {
        ("2025-01-10-DO1.zip", "DO1", "2025-01-10"),
        ("2025-01-10-DO3E.zip", "DO3", "2025-01-10"),
        ("2025_01_11_ASSINADO_do2_extra_B.pdf", "DO2", "2025-01-11"),
        ("2025_01_11_ASSINADO_do2.pdf", "DO2", "2025-01-11"),
    }


def test_listing_reads_no_content(spark, tmp_path):
    editions.archive(tmp_path, "2025-01-10-DO1.zip", ["a"])
    plan = listing.stored_files(spark, str(tmp_path))._jdf.queryExecution().toString()
    assert "ReadSchema: struct<path:string,length:bigint>" in plan


@pytest.mark.parametrize("tile", [4, 1024])
def test_pages_begin_where_the_whole_text_has_them(spark, monkeypatch, tile):
    monkeypatch.setattr(pages, "PAGE_TILE", tile)
    rows = [("f", i, f" p{i} " if i % 3 else "  ") for i in range(20)] + [("g", 0, "um"), (None, 1, "a"), (None, 2, "b")]
    frame = spark.createDataFrame(rows, "file string, page int, text string")
    got = pages.assembled_text(frame, "file", "page").orderBy("file", "n").collect()
    for file in ("f", "g", None):
        own = [r for r in got if r.file == file]
        whole = "\n\n".join(t.strip() for f, _, t in rows if f == file and t.strip())
        assert "\n\n".join(r.text for r in own) == whole
        assert [r.n for r in own] == list(range(1, len(own) + 1))
        assert all(whole[r.begins :].startswith(r.text) for r in own)


def test_pages_with_several_lines(spark, monkeypatch):
    monkeypatch.setattr(pages, "PAGE_TILE", 2)
    texts = ["a\nb", " ", "\nc\n\nd\n", "", "e"]
    rows = [("f", "DO1", None, i, t) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(
        rows, "file_name string, secao string, edition_date date, page_no long, text string"
    )
    # The day is unknown here; a null key is a value like any other.
    got = pages.page_lines(frame).orderBy("line_no").collect()
    assert "\n".join(r.line for r in got) == "a\nb\n\nc\n\nd\n\ne"
    assert {r.n_lines for r in got} == {len(got)}


@pytest.mark.parametrize("levels", [["a"], ["a", "b"], ["a", "b", "c"]])
def test_ranks_equal_a_full_sort(spark, levels):
    rows = [(g, i % 3, i % 5, i % 7, (i * 37) % 101) for g in "xy" for i in range(101)]
    frame = spark.createDataFrame(rows, "g string, a int, b int, c int, k int")
    got = numbering.ordered_rank(frame, ["g"], levels, ["k"], "n", "total").collect()
    for g in "xy":
        mine = [r for r in got if r.g == g]
        mine.sort(key=lambda r: (*[r[c] for c in levels], r.k))
        assert [r.n for r in mine] == list(range(101))
        assert {r.total for r in mine} == {101}
    everywhere = numbering.ordered_rank(frame, [], ["g", *levels], ["k"], "n").collect()
    assert sorted(r.n for r in everywhere) == list(range(202))


def test_line_offsets(spark):
    texts = ["", "a", "a\n\nbc\n", "\n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    for r in documents.line_offsets(docs, "id").collect():
        lines = texts[r.id].split("\n")
        assert r.n_chars == len(lines[r.line_no])
        assert r.line_offset == sum(len(x) + 1 for x in lines[: r.line_no])


def test_rules_from_json(spark, tmp_path):
    R.rules_frame(spark).write.json(str(tmp_path / "rules"))
    assert sorted(R.read_rules(spark, str(tmp_path / "rules")).collect()) == sorted(
        R.rules_frame(spark).collect()
    )


def test_archives_as_a_data_source(spark, tmp_path):
    from gazewatch.sources import archive_source

    archive_source.register(spark)
    for day in (8, 9, 10):
        editions.archive(tmp_path, f"2025-01-{day:02}-DO1.zip", [f"ato {day} {i} " + "x" * 50 for i in range(5)], [("a.txt", "no")])
    big = [f"grande {i} {'abc' * i}" for i in range(300)]
    editions.archive(tmp_path / "sub", "2025-01-10-DO2.zip", big)
    editions.broken(tmp_path, "2025-01-11-DO3.zip")
    editions.broken(tmp_path, "2025-13-11-DO3.zip")

    frame = spark.read.format("edition_archives").option("partBytes", 20_000).load(str(tmp_path))
    rows = frame.collect()
    whole = archives.archive_entries(listing.stored_files(spark, str(tmp_path))).collect()
    told = lambda rows: sorted((r.file_name, r.secao, str(r.edition_date), r.entry_no or -1, r.xml or "", r.err or "") for r in rows)
    assert told(rows) == told(whole) and len(rows) == 316
    # Tasks follow the bytes: one archive is read by several, small ones share a task.
    lengths = {a.file_name: a.length for a in archive_source.archives_in(str(tmp_path))}
    parts = archive_source.planned(archive_source.archives_in(str(tmp_path)), 20_000)
    assert sum("2025-01-10-DO2.zip" in [a.file_name for a in p.archives] for p in parts) == -(-lengths["2025-01-10-DO2.zip"] // 20_000) > 1
    assert frame.rdd.getNumPartitions() == len(parts) < len(lengths) + 10
    # Without the column no content is read; the broken member of an archive is not noticed.
    names = spark.read.format("edition_archives").schema("file_name string, entry_no bigint").load(str(tmp_path))
    assert names.where("entry_no IS NOT NULL").count() == 315
    with pytest.raises(Exception, match="no column"):
        spark.read.format("edition_archives").schema("size bigint").load(str(tmp_path)).count()
    # Filters leave archives out, and SQL reads it.
    spark.sql(f"CREATE TEMPORARY VIEW editions_read USING edition_archives OPTIONS (path '{tmp_path}')")
    got = spark.sql("SELECT count(*) FROM editions_read WHERE secao = 'DO1' AND edition_date = DATE'2025-01-09' AND entry_no > 1")
    assert got.first()[0] == 3
    reader = archive_source.EditionArchives({"path": str(tmp_path)}).reader(archives.schemas.ENTRIES)
    left = list(reader.pushFilters([archive_source.EqualTo(("secao",), "DO1"), archive_source.EqualTo(("entry_no",), 1)]))
    assert len(left) == 1 and {a.file_name for p in reader.partitions() for a in p.archives} == {f"2025-01-{d}-DO1.zip" for d in ("08", "09", "10")}


def test_tasks_follow_the_bytes_of_archives(spark, tmp_path):
    editions.archive(tmp_path, "2025-01-10-DO1.zip", [f"ato {i}" for i in range(300)])
    files = listing.stored_files(spark, str(tmp_path))
    length = files.first().length
    assert length == (tmp_path / "2025-01-10-DO1.zip").stat().st_size
    assert archives.tasks_for(files, 1000) == length * archives.UNPACKED // 1000 + 1
    assert archives.tasks_for(files, 1 << 30) == 1


def test_listings_of_days(spark, tmp_path):
    for name in ("2025-01-08-DO1.zip", "2025-01-10-DO1E.zip", "2025_01_10_ASSINADO_do1.pdf"):
        (tmp_path / name).write_bytes(b"x")
    found = lambda days: {r.file_name for r in listing.stored_files(spark, str(tmp_path), days).collect()}
    assert found([date(2025, 1, 10)]) == {"2025-01-10-DO1E.zip", "2025_01_10_ASSINADO_do1.pdf"}
    assert len(found(None)) == 3 and found([]) == set() and found([date(2020, 1, 1)]) == set()
