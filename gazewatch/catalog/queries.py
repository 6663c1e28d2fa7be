"""One query per operator, over the whole of the given tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazewatch import fixed
from gazewatch.catalog import gazette
from gazewatch.catalog.gazette import table
from gazewatch.functions import dates as D
from gazewatch.functions import sizing
from gazewatch.functions import text as X
from gazewatch.functions.rows import where_present
from gazewatch.functions.sizing import stage
from gazewatch.operators import acts as A
from gazewatch.operators import digest as G
from gazewatch.operators import report, select
from gazewatch.plans import search
from gazewatch.sinks.tables import with_ids
from gazewatch.sources import documents, listing, pages
from gazewatch.sources import rules as R

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

BACK, FORWARD = fixed.LINES_BACK, fixed.LINES_FORWARD
LEDGER_BEFORE = date(1997, 1, 1)
TARGET = date(1997, 5, 3)
RANGE = (date(1995, 1, 1), date(2001, 12, 31))
DAY = date(1997, 6, 15)
AS_OF = date(2024, 2, 5)
PREFIX = "[DOU]"
KEYWORDS = ("enen", "réaux", "ndthe")
KEYWORD = "enen"
LINK_PATTERNS = (r'href="(/[a-z]+)"', r'href="(/[a-z,]+)"')

DOCUMENT_RULES = (
    R.FilterRule("english", "en", "The", ("eren", "ATION")),
    R.FilterRule("german", "de", "der", ("enen", "heit", "ß")),
    R.FilterRule("french", "fr", "Les", ("tion",)),
    R.FilterRule("spanish", "es", "las", ("ción", "ñ")),
    R.FilterRule("english-contact", "en", "license", ("a",)),
)
SYLLABLES = ("en", "er", "th", "on", "at", "ed", "re", "in", "nd", "sh")
LANGUAGES = ("en", "de", "fr", "es")
PATTERN_RULES = (
    R.FilterRule("numbers", "DO1", "", (r"re:n[ºo°]\s*[1-3]\b", r"re:portaria \w+ nº \d, de 0?[12] de", "resolve")),
    R.FilterRule("words", "DO2", "", (r"re:(sufer|delibera\w+) item \d+5\z", r"re:\AT.{3,9}ato re")),
    R.FilterRule("any", "DO3", "", (r"re:\d{4,}|DEZEMBRO", r"re:ins?tru[cç][aã]o", r"re:item 1?2+3")),
)
ENTRY_RULES = (R.FilterRule("en", "DO1", "the", ("ing", "tion")), R.FilterRule("de", "DO1", "die", ("enen",)))
ENTRY_TITLES = (r"\A[ET]\w+\s+\w+", r"\A[DIL]\w+\s+\w+\s+\w+")
DOCUMENT_TITLES = (r"\AE\w+\s+\w+", r"\A[DT]\w+\s+\w+")


def query(function: Query) -> Query:
    REGISTRY[function.__name__] = function
    return function


def _rules(spark: SparkSession) -> DataFrame:
    return R.rules_frame(spark, gazette.RULES)


def _matches(spark: SparkSession, folder: str) -> DataFrame:
    lines = gazette.staged_lines(spark, folder)
    return search.find_matches(lines, _rules(spark), back=BACK, forward=FORWARD)


def _stored(spark: SparkSession, folder: str) -> DataFrame:
    """Matches as a run leaves them: in a table."""
    return stage(_matches(spark, folder), "matches")


def _hits(spark: SparkSession, folder: str) -> DataFrame:
    marked = A.marked_lines(gazette.lines(spark, folder), _rules(spark))
    return A.nearest_titles(marked, BACK, FORWARD)


def _ledger(spark: SparkSession, folder: str) -> DataFrame:
    return gazette.files(spark, folder).where(F.col("edition_date") < F.lit(LEDGER_BEFORE))


# --- search -------------------------------------------------------------------


@query
def all_matches(spark, folder):
    return _matches(spark, folder)


@query
def publications(spark, folder):
    lines = gazette.staged_lines(spark, folder)
    marked = A.marked_lines(lines, _rules(spark))
    acts = A.hit_acts(A.act_bounds(A.nearest_titles(marked, BACK, FORWARD)))
    return A.publications(A.with_full_text(A.label_untitled(stage(acts, "acts"), lines), lines))


@query
def dedup_by_title(spark, folder):
    lines = gazette.staged_lines(spark, folder)
    acts = search.find_acts(lines, _rules(spark), back=BACK, forward=FORWARD)
    return acts.drop("keyword_ord", "filter_name")


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("file_name"),
        F.col("lang").alias("secao"),
        F.lit(date(2024, 1, 1)).alias("edition_date"),
        "text",
    )


@query
def document_matches(spark, folder):
    return search.find_matches_in_documents(
        _documents(spark, folder),
        R.rules_frame(spark, DOCUMENT_RULES),
        patterns=DOCUMENT_TITLES,
        back=BACK,
        forward=FORWARD,
    )


@query
def entry_scoped_matches(spark, folder):
    """Conversations as files, turns as their entries: acts end with the turn they are in."""
    lines = stage(pages.page_lines(_paged(spark, folder), entry_scoped=True), "lines")
    rules = R.rules_frame(spark, ENTRY_RULES)
    return search.find_matches(lines, rules, patterns=ENTRY_TITLES, back=BACK, forward=FORWARD)


@query
def asof_title_back(spark, folder):
    return _hits(spark, folder).select(
        "file_name",
        "filter_ord",
        "keyword_ord",
        "line_no",
        F.col("opening.line_no").alias("title_line"),
        F.col("opening.title").alias("title"),
    )


@query
def asof_title_next(spark, folder):
    return _hits(spark, folder).select(
        "file_name", "filter_ord", "keyword_ord", "line_no", "next_title"
    )


@query
def extract_title(spark, folder):
    titled = A.titled_lines(gazette.lines(spark, folder))
    return titled.select("file_name", "line_no", "title")


@query
def title_date(spark, folder):
    titled = A.titled_lines(gazette.lines(spark, folder))
    found = X.title_date(F.col("title")).alias("publication_date")
    return titled.select("file_name", "line_no", "title", found)


@query
def keyword_line_hits(spark, folder):
    hits = A.keyword_lines(gazette.lines(spark, folder), _rules(spark))
    return hits.select("file_name", "line_no", "filter_ord", "keyword")


@query
def keyword_index_hits(spark, folder):
    """Six keywords for every part, beyond the broadcast limits from some thousand parts on.

    They are the number of the part, and made-up words that spell its last digits.
    """
    number = F.col("p_partkey").cast("string")
    spelled = reduce(
        lambda s, d: F.replace(s, F.lit(str(d[0])), F.lit(d[1])), enumerate(SYLLABLES), F.lpad(number, 4, "0")
    )
    words = [F.right(spelled, F.lit(n)) for n in (6, 8)]
    keywords = [number, *words, F.concat(words[0], F.lit(" ")), F.concat(words[0], F.lit(".")), F.concat(F.lit(" "), words[1])]
    rules = table(spark, folder, "part").select(
        F.col("p_partkey").cast("int").alias("filter_ord"),
        F.col("p_brand").alias("nome"),
        F.get(F.array(*[F.lit(s) for s in LANGUAGES]), (F.col("p_partkey") % len(LANGUAGES)).cast("int")).alias("secao"),
        F.lit("").alias("orgao"),
        F.array(*keywords).alias("keywords"),
    )
    # A small file is read by one task; its lines are searched by all.
    docs = _documents(spark, folder).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    lines = stage(documents.document_lines(docs), "lines")
    hits = A.keyword_lines(lines, R.checked(rules))
    return hits.select("file_name", "line_no", "filter_ord", "keyword_ord", "keyword")


@query
def regex_keyword_hits(spark, folder):
    hits = A.keyword_lines(gazette.lines(spark, folder), R.rules_frame(spark, PATTERN_RULES))
    return hits.select("file_name", "line_no", "filter_ord", "keyword")


@query
def org_gate(spark, folder):
    gate = A.organisation_gate(gazette.lines(spark, folder), _rules(spark))
    return gate.select("file_name", "filter_ord")


@query
def org_theta_join(spark, folder):
    docs = table(spark, folder, "documents").select(
        "doc_id", F.col("lang").alias("secao"), X.fold(F.col("text")).alias("_folded")
    )
    rules = R.rules_frame(spark, DOCUMENT_RULES).drop("keywords")
    hit = F.contains(F.col("_folded"), X.fold(F.col("orgao")))
    return sizing.join_rules(docs, rules, hit, "inner").select("doc_id", "secao", "nome", "orgao")


# --- documents ----------------------------------------------------------------


@query
def keyword_any_filter(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    folded = docs.withColumn("_folded", X.fold(F.col("text")))
    hit = X.any_of([F.contains(F.col("_folded"), F.lit(k.lower())) for k in KEYWORDS])
    return folded.where(hit).drop("_folded")


@query
def keyword_count(spark, folder):
    return table(spark, folder, "documents").select(
        "doc_id", X.keyword_count(F.col("text"), KEYWORD).alias("n")
    )


def _occurrences(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return documents.occurrences(docs, KEYWORD)


@query
def keyword_positions(spark, folder):
    return _occurrences(spark, folder).select("doc_id", "position")


@query
def context_snippet(spark, folder):
    snippet = X.context_snippet(F.col("text"), F.col("position"))
    return _occurrences(spark, folder).select("doc_id", "position", snippet.alias("snippet"))


@query
def locate_line(spark, folder):
    return _occurrences(spark, folder).select("doc_id", "position", "line_no")


@query
def line_offsets(spark, folder):
    return documents.line_offsets(table(spark, folder, "documents"), "doc_id")


@query
def doc_lines(spark, folder):
    docs = table(spark, folder, "documents")
    cut = docs.select("doc_id", F.posexplode(documents.split_lines(F.col("text"))))
    return cut.select("doc_id", F.col("pos").cast("bigint").alias("line_no"), F.col("col").alias("line"))


@query
def strip_markup(spark, folder):
    web = table(spark, folder, "pages").select("page_id", "html")
    text = F.nullif(X.strip_markup(F.col("html")), F.lit(""))
    return where_present(web, "text", text).drop("html")


def _page_text(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "conversations").select("conv_id", "turn", "text")


def _paged(spark: SparkSession, folder: str) -> DataFrame:
    return _page_text(spark, folder).select(
        F.concat(F.lit("conv-"), F.col("conv_id").cast("string")).alias("file_name"),
        F.lit("DO1").alias("secao"),
        F.lit(date(2024, 1, 1)).alias("edition_date"),
        F.col("turn").alias("page_no"),
        "text",
    )


@query
def paged_text_assemble(spark, folder):
    return pages.assembled_text(_page_text(spark, folder), "conv_id", "turn")


@query
def paged_text_lines(spark, folder):
    lines = pages.page_lines(_paged(spark, folder))
    return lines.select("file_name", "n_lines", "line_no", "line")


# --- listings and selection ------------------------------------------------------


@query
def listing_extract(spark, folder):
    """Listing pages by month, which hold the names of all days and sections of the month."""
    names = gazette.files(spark, folder).withColumn(
        "listed", F.trunc("edition_date", "month")
    )
    anchor = F.concat(
        F.lit('<a href="?dl='), F.col("file_name"), F.lit('">'), F.col("file_name"), F.lit("</a>")
    )
    body = F.expr("listagg(anchor, '\\n') WITHIN GROUP (ORDER BY anchor)")
    # At most three days, three sections and four kinds of file make up a page.
    listed = names.withColumn("anchor", anchor).groupBy("listed").agg(body.alias("body"))
    return listing.listed_files(
        listed.withColumnRenamed("listed", "edition_date"), ["DO1", "DO3"]
    )


@query
def listing_union_distinct(spark, folder):
    return listing.distinct_names(table(spark, folder, "pages"), "html", LINK_PATTERNS)


@query
def file_kind_split(spark, folder):
    return select.with_kind(gazette.files(spark, folder))


@query
def section_filter(spark, folder):
    return select.of_section(gazette.files(spark, folder), "DO2")


@query
def prefer_zip(spark, folder):
    return select.prefer_archives(gazette.files(spark, folder))


@query
def new_files_anti(spark, folder):
    return select.new_files(gazette.files(spark, folder), _ledger(spark, folder))


@query
def processed_semi(spark, folder):
    return select.processed_files(gazette.files(spark, folder), _ledger(spark, folder))


@query
def ledger_upsert(spark, folder):
    known = _ledger(spark, folder).select(
        "file_name", F.col("edition_date").alias("processed_date")
    )
    # Every file is reported twice, the second time a day later.
    files = gazette.files(spark, folder).select("file_name", "edition_date")
    again = files.withColumn("edition_date", F.date_add("edition_date", 1))
    added = select.ledger_additions(files.unionByName(again), known)
    return known.unionByName(added)


@query
def matches_committed(spark, folder):
    """Matches of monthly runs. The later months' files are in the ledger from another run."""
    run_id = F.concat(F.lit("run-"), F.date_format("edition_date", "yyyy-MM"))
    later = F.col("edition_date") >= F.lit(LEDGER_BEFORE)
    ledger = gazette.files(spark, folder).select("file_name", F.when(later, F.lit("other")).otherwise(run_id).alias("run_id"))
    found = _acts_in(gazette.staged_lines(spark, folder)).select(
        F.col("file_name").alias("source_file"), run_id.alias("run_id"), "filter_name",
        F.col("keyword").alias("keyword_hit"), "line_no",
    )
    return select.committed(found, ledger)


@query
def filter_section_join(spark, folder):
    joined = select.rules_for_files(gazette.files(spark, folder), _rules(spark))
    return joined.drop("keywords")


@query
def claim_all_filters(spark, folder):
    return select.claims(gazette.files(spark, folder), _rules(spark), "all_filters")


@query
def claim_first_filter(spark, folder):
    return select.claims(gazette.files(spark, folder), _rules(spark), "first_filter")


@query
def filters_explode(spark, folder):
    """Rules made from parts: the words of a part name are the keywords."""
    rules = table(spark, folder, "part").select(
        F.col("p_partkey").cast("int").alias("filter_ord"),
        F.col("p_brand").alias("nome"),
        F.col("p_type").alias("secao"),
        F.lit("").alias("orgao"),
        F.split("p_name", " ").alias("keywords"),
    )
    return R.keywords(R.checked(rules)).drop("orgao")


@query
def filter_date_grid(spark, folder):
    targets = gazette.files(spark, folder).select(
        "secao", F.col("edition_date").alias("target_date")
    )
    return R.rule_dates(_rules(spark), targets.distinct(), 2)


@query
def lookback_window(spark, folder):
    day = F.to_date("o_orderdate")
    orders = table(spark, folder, "orders")
    return orders.where(D.in_lookback(F.col("o_orderdate"), DAY, 30)).select(
        "o_orderkey", day.alias("day")
    )


@query
def exact_day(spark, folder):
    orders = table(spark, folder, "orders")
    return orders.where(D.on_day(F.to_date("o_orderdate"), DAY)).select(
        "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")
    )


@query
def date_spine(spark, folder):
    """Every day from the first order to the last with its number of orders."""
    days = table(spark, folder, "orders").select(F.to_date("o_orderdate").alias("day"))
    counts = days.groupBy("day").agg(F.count(F.lit(1)).alias("n_orders"))
    span = days.agg(F.min("day").alias("first"), F.max("day").alias("last"))
    spine = span.select(F.explode(D.days_between(F.col("first"), F.col("last"))).alias("day"))
    return spine.join(counts, "day", "left").select(
        "day", F.coalesce("n_orders", F.lit(0).cast("bigint")).alias("n_orders")
    )


@query
def recent_matches(spark, folder):
    events = table(spark, folder, "events").select("event_id", "ts", "event_type")
    return report.recent(events, "ts", AS_OF)


@query
def heartbeat_window(spark, folder):
    return table(spark, folder, "events").select(
        "event_id", "ts", D.is_heartbeat(F.col("ts")).alias("is_heartbeat")
    )


# --- digest and reports ------------------------------------------------------------


@query
def distinct_sections(spark, folder):
    return G.distinct_sections(gazette.files(spark, folder))


def _numbered(spark: SparkSession, folder: str) -> DataFrame:
    """Every edition day is a run of its own."""
    stored = _stored(spark, folder)
    return G.numbered(stored.withColumn("run_date", F.col("edition_date")))


@query
def digest_numbered(spark, folder):
    title, day = F.col("publication_title"), F.col("publication_date")
    return _numbered(spark, folder).select(
        "run_date",
        "n",
        "n_matches",
        "filter_name",
        "source_file",
        "keyword_hit",
        G.heading(title, day).alias("heading"),
    )


@query
def digest(spark, folder):
    return G.digest(_numbered(spark, folder), PREFIX, "DO1, DO2")


@query
def digest_items(spark, folder):
    return G.digest_items(_numbered(spark, folder))


@query
def digest_decision(spark, folder):
    """Every hour of the event log is a run; its purchases are its matches."""
    hour = F.date_trunc("hour", "ts")
    bought = F.count_if(F.col("event_type") == "purchase")
    runs = table(spark, folder, "events").groupBy(hour.alias("run_ts")).agg(bought.alias("n_matches"))
    emit = G.is_due(F.col("n_matches"), F.col("run_ts"))
    run_date = F.to_date("run_ts")
    return runs.select(
        F.date_format("run_ts", "yyyy-MM-dd HH").alias("run_hour"),
        "n_matches",
        emit.alias("emit"),
        F.when(emit, G.subject(PREFIX, run_date, F.col("n_matches"))).alias("subject"),
        F.when(emit & (F.col("n_matches") == 0), G.heartbeat(PREFIX, run_date)).alias("body"),
    )


@query
def matches_per_filter(spark, folder):
    return report.matches_per_filter(_acts_in(gazette.staged_lines(spark, folder)))


@query
def matches_per_period(spark, folder):
    return report.matches_per_period(_acts_in(gazette.staged_lines(spark, folder)))


@query
def match_row_ids(spark, folder):
    return with_ids(_stored(spark, folder), highest=1000).select(
        "id", "edition_date", "filter_name", "source_file", "keyword_hit", "line_no"
    )


def _acts_in(lines: DataFrame, chosen: DataFrame | None = None) -> DataFrame:
    """Acts that match, in the chosen files. Counting them takes no text."""
    lines = lines if chosen is None else search.of_files(lines, chosen)
    return search.find_acts(lines, _rules(lines.sparkSession), back=BACK, forward=FORWARD)


@query
def run_for_date(spark, folder):
    """The editions of three days, archives first, without those in the ledger."""
    window = select.in_window(gazette.files(spark, folder), TARGET, 2)
    chosen = select.new_files(select.prefer_archives(window), _ledger(spark, folder))
    lines = stage(select.in_window(gazette.lines(spark, folder), TARGET, 2), "gazette")
    lines = search.of_files(lines, chosen)
    return search.find_matches(lines, _rules(spark), back=BACK, forward=FORWARD)


@query
def run_summary(spark, folder):
    """A run for every edition day: files looked at, matches found, note."""
    chosen = select.prefer_archives(gazette.files(spark, folder))
    processed = chosen.withColumnRenamed("edition_date", "run_date")
    found = _acts_in(gazette.staged_lines(spark, folder), chosen)
    found = found.withColumnRenamed("edition_date", "run_date")
    return report.run_summary(processed, found, None, F.lit(False))


@query
def backfill_rollup(spark, folder):
    chosen = select.prefer_archives(gazette.files(spark, folder))
    found = _acts_in(gazette.staged_lines(spark, folder), chosen)
    return report.per_day(found, *RANGE)
