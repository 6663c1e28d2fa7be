"""Titles, hits and the extent of legal acts, on a table of numbered lines.

A line is ``(file_name, secao, edition_date, n_lines, line_no, line)``. Only lines
with a title or a keyword take part in the windows; the text of an act is fetched
afterwards for the acts that survive.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gazewatch import fixed
from gazewatch.functions import bloom, sizing
from gazewatch.functions import text as X
from gazewatch.functions.rows import where_present
from gazewatch.operators import needles

# Lines per window partition. Large against the lines copied at each edge.
WINDOW_TILE = 8192
# Lines per piece when act texts are put together.
TEXT_TILE = 64

FILE = ("file_name", "secao", "edition_date")


def folded(lines: DataFrame) -> DataFrame:
    """Add the case-folded line as a column, so that all tests on a line share it."""
    return lines.withColumn("_folded", X.fold(F.col("line")))


def with_titles(lines: DataFrame, patterns: Sequence[str] = fixed.TITLE_PATTERNS) -> DataFrame:
    """Add ``title``, null where there is none. The first line of a file is never a title."""
    tried, title = _tried(lines, patterns)
    return tried.select(*lines.columns, title.alias("title"))


def titled_lines(
    lines: DataFrame, patterns: Sequence[str] = fixed.TITLE_PATTERNS
) -> DataFrame:
    """Only the lines with a title."""
    tried, title = _tried(lines, patterns)
    return where_present(tried, "title", title).select(*lines.columns, "title")


def _tried(lines: DataFrame, patterns: Sequence[str]) -> tuple[DataFrame, Column]:
    """Lines with a column for each title pattern, and the title as an expression of those.

    The first pattern that matches wins. A pattern is evaluated once, and only on
    lines with its stem.
    """
    stems = fixed.TITLE_STEMS if tuple(patterns) == fixed.TITLE_PATTERNS else None
    tries = X.title_tries(F.col("_stripped"), F.col("_folded"), patterns, stems)
    names = [f"_title_{i}" for i in range(len(tries))]
    shared = lines if "_folded" in lines.columns else folded(lines)
    tried = shared.withColumn("_stripped", X.strip(F.col("line"))).select(
        *lines.columns, *[t.alias(n) for t, n in zip(tries, names)]
    )
    return tried, F.when(F.col("line_no") >= 1, X.first_title([F.col(n) for n in names]))


GATE = ("file_name", "filter_ord", "n_lines")


def organisation_gate(lines: DataFrame, rules: DataFrame) -> DataFrame:
    """Files that name the rule's organisation anywhere, with their length.

    Found per line and reduced before the shuffle, so file size does not matter.
    """
    orgs = rules.withColumn("keywords", F.array().cast("array<string>"))
    return needles.meet(folded(lines), orgs).select(*GATE).distinct()


def admitted(hits: DataFrame, gate: DataFrame) -> DataFrame:
    """Hits of the rules and files in the gate.

    The gate is repeated per tile of a file and the join is on tiles too, so that
    the hits of one long file, and all that is grouped after them, stay spread.
    """
    tiles = F.sequence(
        F.lit(0).cast("bigint"), F.floor((F.col("n_lines") - 1) / WINDOW_TILE)
    )
    spread_gate = gate.select("file_name", "filter_ord", F.explode(tiles).alias("_tile"))
    tiled = hits.withColumn("_tile", F.floor(F.col("line_no") / WINDOW_TILE))
    return tiled.join(spread_gate, ["file_name", "filter_ord", "_tile"], "left_semi").drop("_tile")


def keyword_lines(lines: DataFrame, rules: DataFrame) -> DataFrame:
    """Lines with each keyword they contain.

    All occurrences on a line belong to the same act, so a line counts once.
    """
    texts = lines if "_folded" in lines.columns else folded(lines)
    return needles.meet(texts, rules, organisations=False).drop("_folded")


def marked_lines(
    lines: DataFrame, rules: DataFrame, patterns: Sequence[str] = fixed.TITLE_PATTERNS
) -> DataFrame:
    """One pass over the text: the lines with a title, a keyword or an organisation, without their text."""
    titled = with_titles(folded(lines), patterns)
    return needles.meet(titled, rules, F.col("title").isNotNull()).drop("line", "_folded")


def gate_of(marked: DataFrame) -> DataFrame:
    """Files that name the rule's organisation, with their length, from the marked lines."""
    return marked.where(F.col("keyword_ord") == needles.ORGANISATION).select(*GATE).distinct()


def nearest_titles(
    marked: DataFrame,
    back: int = fixed.LINES_BACK,
    forward: int = fixed.LINES_FORWARD,
    tile: int | None = None,
) -> DataFrame:
    """For each keyword line the title at or above it and the title that ends the act.

    Adds ``opening`` (``line_no``, ``title``, ``next_title``; null if no title is
    in reach) and ``next_title`` (null if none is in reach). Reach is bounded, so a
    file is cut into tiles of lines, each with the titles just outside its edges:
    a file of any length is spread over many tasks.
    """
    tile = tile or WINDOW_TILE
    line_no = F.col("line_no")
    is_title = F.col("title").isNotNull()
    is_hit = F.coalesce(F.col("keyword_ord") >= 0, F.lit(False))
    own = F.floor(line_no / tile)
    first = F.greatest(F.floor((line_no - (forward - 1)) / tile), F.lit(0).cast("bigint"))
    last = F.floor((line_no + (back - 1)) / tile)
    tiled = marked.where(is_title | is_hit).withColumn(
        "_tile", F.explode(F.when(is_title, F.sequence(first, last)).otherwise(F.array(own)))
    )

    within = Window.partitionBy("file_name", "_tile").orderBy("line_no")
    below = within.rangeBetween(1, forward - 1)
    above = within.rangeBetween(-(back - 1), 0)
    next_title = F.min(F.when(is_title, line_no)).over(below)
    opening = F.when(is_title, F.struct("line_no", "title", "next_title"))
    return (
        tiled.withColumn("next_title", next_title)
        .withColumn("opening", F.last(opening, ignorenulls=True).over(above))
        .where(is_hit & (F.col("_tile") == own))
        .drop("_tile", "title")
    )


def act_bounds(hits: DataFrame) -> DataFrame:
    """Turn the neighbouring titles into ``start_line``, ``end_line`` and ``title``.

    Without a title in reach the act starts at the hit itself; without a next
    title it runs to the end of the file. Where lines tell the limits of their entry
    (``from_line``, ``to_line``), titles outside of it are not in reach, and it ends the act.
    """
    end = F.col("n_lines")
    if "from_line" in hits.columns:
        end = F.col("to_line")
        inside = F.col("opening.line_no") >= F.col("from_line")
        hits = hits.withColumn("opening", F.when(inside, F.col("opening")))
    untitled = F.col("opening").isNull()
    until = F.when(untitled, F.col("next_title")).otherwise(F.col("opening.next_title"))
    until = F.when(until < end, until).otherwise(end)
    return hits.select(
        *FILE,
        "filter_ord",
        "nome",
        "keyword_ord",
        "keyword",
        "line_no",
        F.coalesce(F.col("opening.line_no"), F.col("line_no")).alias("start_line"),
        until.alias("end_line"),
        F.col("opening.title").alias("title"),
    )


def hit_acts(bounds: DataFrame) -> DataFrame:
    """One row per act, rule and keyword, with the first hit line."""
    key = [c for c in bounds.columns if c != "line_no"]
    return bounds.groupBy(*key).agg(F.min("line_no").alias("line_no"))


def of_tiles(lines: DataFrame, tiles: DataFrame) -> DataFrame:
    """Lines of the given tiles, with what else the tiles have.

    A few tiles, with the numbers of 64 lines at most, go to the scan; of more, a Bloom filter does.
    """
    place, n = ["file_name", "_tile"], tiles.count()
    if n <= sizing.BROADCAST_ROWS:
        return lines.join(F.broadcast(tiles), place)
    key, blocks = F.xxhash64(*place), bloom.blocks_for(n)
    return bloom.may_be_in(lines, key, bloom.bloom_filter(tiles, key, blocks), blocks).join(tiles, place)


def act_texts(
    acts: DataFrame, lines: DataFrame, chars: int | None = None, carried: Sequence[str] = ()
) -> DataFrame:
    """The lines ``start_line`` to ``end_line`` of each act of a file as one text, ``_text``.

    Acts overlap: those without a next title share the end of their file. So the text is cut
    once where acts begin and end, each piece is put together once, and an act is a range of
    pieces. Only the lines of tiles that an act touches leave the scan. ``chars`` limits each line to its first so many characters
    after white space. ``acts`` has one row per range; ``carried`` columns stay with it.
    """
    first, last = F.floor(F.col("start_line") / TEXT_TILE), F.floor((F.col("end_line") - 1) / TEXT_TILE)
    others = [F.when(F.col("_tile") == first, F.col(c)).alias(c) for c in carried]
    asked = acts.select("file_name", "start_line", "end_line", *carried, F.explode(F.sequence(first, last)).alias("_tile"))
    asked = asked.select("file_name", "start_line", "end_line", "_tile", *others)
    if carried:  # acts that come with more than their place took some work to find
        asked = sizing.stage(asked, "asked")

    def cuts(edge: str) -> Column:
        return F.collect_set(F.when(F.floor(F.col(edge) / TEXT_TILE) == F.col("_tile"), F.col(edge)))

    touched = asked.groupBy("file_name", "_tile").agg(
        F.concat(cuts("start_line"), cuts("end_line"), F.array(F.col("_tile") * TEXT_TILE)).alias("_cuts")
    )
    touched = sizing.stage(touched, "touched")
    text = F.col("line")
    if chars is not None:
        margin = F.length("line") - F.length(F.ltrim("line", F.lit(fixed.WHITE_SPACE)))
        text = F.substring("line", F.lit(1), margin + chars)
    numbered = lines.select(
        "file_name", F.floor(F.col("line_no") / TEXT_TILE).alias("_tile"), "line_no", text.alias("_line")
    )
    pieces = (
        of_tiles(numbered, touched)
        .withColumn("_piece", F.array_max(F.filter("_cuts", lambda c: c <= F.col("line_no"))))
        .groupBy("file_name", "_tile", "_piece")
        .agg(F.expr("listagg(_line, '\\n') WITHIN GROUP (ORDER BY line_no)").alias("_part"))
    )
    inside = (F.col("_piece") >= F.col("start_line")) & (F.col("_piece") < F.col("end_line"))
    return (
        asked.join(pieces, ["file_name", "_tile"])
        .where(inside)
        .groupBy("file_name", "start_line", "end_line")
        .agg(
            F.expr("listagg(_part, '\\n') WITHIN GROUP (ORDER BY _piece)").alias("_text"),
            *[F.first(c, ignorenulls=True).alias(c) for c in carried],
        )
    )


def label_untitled(
    bounds: DataFrame, lines: DataFrame, chars: int = fixed.TITLE_CHARS
) -> DataFrame:
    """Give acts without a title the beginning of their text. ``is_titled`` keeps the difference.

    ``chars`` characters lie within as many lines, so no more lines are read, and no more
    than ``chars`` characters of each; each act is read once, whatever hit it.
    """
    act = ["file_name", "start_line", "end_line"]
    until = F.least(F.col("end_line"), F.col("start_line") + chars)
    untitled = bounds.where("title IS NULL").select(*act[:2], until.alias("end_line")).distinct()
    labels = act_texts(untitled, lines, chars).select(
        F.col("file_name").alias("_file"),
        F.col("start_line").alias("_start"),
        F.col("end_line").alias("_end"),
        X.untitled_label(X.strip(F.col("_text")), chars).alias("_label"),
    )
    on = (
        F.col("title").isNull()
        & (F.col("file_name") == F.col("_file"))
        & (F.col("start_line") == F.col("_start"))
        & (until == F.col("_end"))
    )
    labelled = bounds.join(labels, on, "left").withColumn("is_titled", F.col("title").isNotNull())
    return labelled.withColumn("title", F.coalesce("title", "_label")).select(*bounds.columns, "is_titled")


def first_per_title(acts: DataFrame) -> DataFrame:
    """Per file, rule, keyword and title keep the act with the lowest hit line.

    Minima combine before the shuffle, so copies of one title never gather anywhere.
    """
    key = [*FILE, "filter_ord", "nome", "keyword_ord", "keyword", "title"]
    first = [F.min_by(c, "line_no").alias(c) for c in ("start_line", "end_line", "is_titled")]
    return acts.groupBy(*key).agg(F.min("line_no").alias("first_line"), *first).withColumnRenamed(
        "first_line", "line_no"
    )


def with_full_text(kept: DataFrame, lines: DataFrame) -> DataFrame:
    """Fetch the text of the acts that are left, once per act whatever hit it.

    ``hits`` holds one element per keyword of the section at most.
    """
    act = ["file_name", "start_line", "end_line"]
    others = [c for c in kept.columns if c not in act]
    acts = kept.groupBy(*act).agg(F.collect_list(F.struct(*others)).alias("hits"))
    whole = act_texts(acts, lines, carried=["hits"])
    return whole.select(*act, X.strip(F.col("_text")).alias("full_text"), F.inline("hits"))


def publications(acts: DataFrame, fallback_chars: int = fixed.FALLBACK_CHARS) -> DataFrame:
    """The stored form of a match. Without any title only so much of the text is kept."""
    untitled_text = F.substring("full_text", 1, fallback_chars)
    return acts.select(
        *[c for c in ("id",) if c in acts.columns],
        "edition_date",
        "filter_ord",
        F.col("nome").alias("filter_name"),
        F.col("file_name").alias("source_file"),
        "keyword_ord",
        F.col("keyword").alias("keyword_hit"),
        "line_no",
        F.col("title").alias("publication_title"),
        F.when(F.col("is_titled"), X.title_date(F.col("title")))
        .otherwise(F.lit(""))
        .alias("publication_date"),
        X.snippet(F.col("full_text")).alias("text_snippet"),
        F.when(F.col("title") == "", untitled_text).otherwise(F.col("full_text")).alias("full_text"),
    )
