"""From lines or documents to matches, as one declarative plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazewatch import fixed
from gazewatch.functions import sizing
from gazewatch.functions import text as X
from gazewatch.functions.sizing import stage
from gazewatch.operators import acts as A
from gazewatch.sources import rules as R
from gazewatch.sources.documents import document_lines


def gated_hits(
    lines: DataFrame,
    rules: DataFrame,
    patterns: Sequence[str] = fixed.TITLE_PATTERNS,
    back: int = fixed.LINES_BACK,
    forward: int = fixed.LINES_FORWARD,
    gate: DataFrame | None = None,
    allowed: DataFrame | None = None,
) -> DataFrame:
    """Keyword lines of admitted files with the bounds of the act around each.

    The text is read once, for titles, keywords and organisations; what is marked is staged
    without text. Files are admitted on the few rows that hit: the gate is as short as the
    list of files and only ever meets hits.
    """
    marked = stage(A.marked_lines(lines, rules, patterns), "marked")
    gate = A.gate_of(marked) if gate is None else gate
    if allowed is not None:
        gate = gate.join(allowed, ["file_name", "filter_ord"], "left_semi")
    return A.act_bounds(A.admitted(A.nearest_titles(marked, back, forward), gate))


def find_matches(
    lines: DataFrame,
    rules: DataFrame,
    patterns: Sequence[str] = fixed.TITLE_PATTERNS,
    back: int = fixed.LINES_BACK,
    forward: int = fixed.LINES_FORWARD,
    gate: DataFrame | None = None,
    allowed: DataFrame | None = None,
    fallback_chars: int = fixed.FALLBACK_CHARS,
) -> DataFrame:
    """Matches of every rule in every file.

    ``allowed`` (``file_name, filter_ord``) restricts which rule may see which file.
    The lines are scanned for the marks, for the labels of untitled acts and for the act
    texts, so a table that is costly to derive should be staged first.
    """
    kept = _kept(lines, rules, patterns=patterns, back=back, forward=forward, gate=gate, allowed=allowed)
    return with_texts(kept, lines, fallback_chars)


def with_texts(acts: DataFrame, lines: DataFrame, fallback_chars: int = fixed.FALLBACK_CHARS) -> DataFrame:
    """Matches with their text, from acts that match; other columns of these are dropped but ``id``."""
    if "filter_name" in acts.columns:
        acts = acts.withColumnRenamed("filter_name", "nome")
    return A.publications(A.with_full_text(acts, lines), fallback_chars)


def find_acts(lines: DataFrame, rules: DataFrame, **options) -> DataFrame:
    """The acts that match, without their text: enough to count, date and name matches."""
    return _kept(lines, rules, **options).withColumnRenamed("nome", "filter_name")


def _kept(lines: DataFrame, rules: DataFrame, **options) -> DataFrame:
    bounds = stage(A.hit_acts(gated_hits(lines, rules, **options)), "bounds")
    return A.first_per_title(A.label_untitled(bounds, lines))


def of_files(lines: DataFrame, files: DataFrame) -> DataFrame:
    """Lines of the given files only, dropped in the scan before anything is searched.

    A list of files within the broadcast limits meets the lines as they are read. A larger
    one is joined by file name and day, which the planner sizes.
    """
    names = stage(files.select("file_name").distinct(), "names")
    if sizing.fits_broadcast(names):
        names = F.broadcast(names)
    return lines.join(names, "file_name", "left_semi").select(*lines.columns)


def find_matches_in_documents(docs: DataFrame, rules: DataFrame, **options) -> DataFrame:
    """The same for documents that hold their text in one row.

    The documents are read once. Those that cannot match are dropped before they are
    cut into lines, and the lines of the others are staged.
    """
    lines = stage(document_lines(may_match(docs, rules)), "lines")
    return find_matches(lines, rules, **options)


def may_match(docs: DataFrame, rules: DataFrame) -> DataFrame:
    """Documents that name the organisation and a keyword of some rule, where this can be told.

    A regular expression may be anywhere. A rule table beyond the broadcast limits is left to
    the index of its needles, which looks at lines.
    """
    if not sizing.fits_broadcast(rules):
        return docs
    needles = rules.select(
        "secao",
        X.fold(F.col("orgao")).alias("_org"),
        F.transform(
            "keywords", lambda k: F.when(F.startswith(k, F.lit(R.PATTERN_PREFIX)), "").otherwise(X.fold(k))
        ).alias("_needles"),
    )
    folded = docs.withColumn("_folded", X.fold(F.col("text")))
    hit = F.contains(F.col("_folded"), F.col("_org")) & F.exists(
        "_needles", lambda k: F.contains(F.col("_folded"), k)
    )
    return sizing.join_rules(folded, needles, hit, "left_semi", True).drop("_folded")
