"""Which lines hold which needles, for rule tables of any size.

A small rule table is held by every executor, and a line is tested against the needles of its
section. A large one is indexed: every needle is filed under one short piece of itself, the
one that the fewest lines hold, with some characters on either side of it. In the scan, Bloom
filters of the pieces and of these stretches are probed with what a line holds, and only what
passes leaves it for an equi-join with the needles. That is the line's place and the stretch; its
text goes along for needles longer than their stretch and for regular expressions.

A keyword that begins with ``re:`` is a regular expression, searched in each line without
regard to case. The longest text that every match of it must contain is its needle; the
expression itself is only tried on lines that hold it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazewatch import fixed
from gazewatch.functions import bloom, sizing
from gazewatch.functions import text as X
from gazewatch.functions.rows import where_present
from gazewatch.sources import rules as R

# In place of a keyword's number: the organisation of the rule.
ORGANISATION = -1
# Characters in a piece under which a needle is filed; shorter needles are their own piece.
GRAM = 4
# Characters on either side of a piece by which lines tell the needles filed under it.
EDGE = 8
# Pieces share so many lists of the ways in which they are widened, whatever their number.
BUCKETS = 1 << 16
# Of more different characters in needles, any character may be in a piece.
LETTERS = 256


def required_text(pattern: Column) -> Column:
    """The longest stretch that any match of a pattern contains as it is, or an empty string.

    Read cautiously: nothing is required of a pattern with alternatives or nested groups;
    groups, classes, shorthands, repeated or optional characters end a stretch.
    """
    gap = "\x00"
    cut = F.regexp_replace(pattern, r"\\[A-Za-z0-9]|\[[^\]]*\]", gap)
    cut = F.regexp_replace(cut, r"\([^()]*\)[?*+]?(\{[^}]*\})?", gap)
    plain = ~F.contains(pattern, F.lit("|")) & ~cut.rlike(r"(?<!\\)[()\[\]]")
    cut = F.regexp_replace(cut, r"\\?.([?*]|\{[^}]*\})[?+]?", gap)
    cut = F.regexp_replace(cut, r"(?<!\\)[.^$]|\+\??", gap)
    stretches = F.split(F.regexp_replace(cut, r"\\(.)", "$1"), gap, -1)
    longest = F.aggregate(
        stretches, F.lit(""), lambda best, s: F.when(F.length(s) > F.length(best), s).otherwise(best)
    )
    return F.when(plain, longest).otherwise("")


def loosely(text: Column) -> Column:
    """Folded so far that two letters that match without regard to case are the same."""
    lower = F.lower(F.upper(F.lower(F.replace(text, F.lit("İ"), F.lit("i")))))
    return F.replace(lower, F.lit("ς"), F.lit("σ"))


def needles(rules: DataFrame, organisations: bool = True) -> DataFrame:
    """Keywords and, as number -1, organisations: (filter_ord, nome, secao, keyword_ord, keyword,
    _needle, _pattern)."""
    rows = R.keywords(rules)
    if organisations:
        orgs = rules.select(
            "filter_ord", "nome", "secao", "orgao", F.lit(ORGANISATION).alias("keyword_ord"), F.col("orgao").alias("keyword")
        )
        rows = rows.unionByName(orgs)
    written = F.substring("keyword", F.lit(len(R.PATTERN_PREFIX) + 1), F.length("keyword"))
    is_pattern = (F.col("keyword_ord") >= 0) & F.startswith("keyword", F.lit(R.PATTERN_PREFIX))
    spelled = reduce(lambda p, s: F.replace(p, F.lit(s[0]), F.lit(s[1])), X.SHORTHANDS, written)
    return rows.drop("orgao").select(
        "*",
        F.when(is_pattern, loosely(required_text(written))).otherwise(X.fold(F.col("keyword"))).alias("_needle"),
        F.when(is_pattern, F.concat(F.lit("(?iud)"), spelled)).alias("_pattern"),
    )


def holds() -> Column:
    """Whether a line (``line``, ``_folded``, ``line_no``) holds a needle.

    An organisation without a name is found on the first line of every file.
    """
    as_text = F.contains("_folded", "_needle") & ((F.col("_needle") != "") | (F.col("line_no") == 0))
    as_pattern = F.contains(loosely(F.col("line")), F.col("_needle")) & F.call_function("rlike", F.col("line"), F.col("_pattern"))
    return F.when(F.col("_pattern").isNull(), as_text).otherwise(as_pattern)


def meet(
    lines: DataFrame, rules: DataFrame, besides: Column | None = None, organisations: bool = True
) -> DataFrame:
    """Lines (with ``_folded``) with each needle of their section that they hold.

    Lines for which ``besides`` is true are there once more, or if they hold no needle at
    least once, with nulls in place of a needle.
    """
    wanted = needles(rules, organisations)
    named = ["filter_ord", "nome", "keyword_ord", "keyword"]
    columns = [*lines.columns, *named]
    small = sizing.fits_broadcast(rules, F.size("keywords") + int(organisations))
    if small and besides is not None:
        met = sizing.join_rules(lines, wanted, holds(), "left", True).select(*columns)
        return met.where(besides | F.col("filter_ord").isNotNull())
    found = sizing.join_rules(lines, wanted, holds(), "inner", True) if small else _indexed(lines, wanted)
    found = found.select(*columns)
    if besides is None:
        return found
    empty = {c: F.lit(None).cast(found.schema[c].dataType) for c in named}
    return found.unionByName(lines.where(besides).withColumns(empty))


def _grams(text: Column, size: int, letter: str = ".", edge: int = 0) -> Column:
    """All stretches of so many characters, each once, with ``edge`` more before and up to that many after them."""
    found = "." * edge + letter * size + f".{{0,{edge}}}" * (edge > 0)
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=({found}))"), F.lit(1)))


def _letters(filed: DataFrame) -> dict[int, str]:
    """For each size of pieces, what matches the characters of the texts filed under such pieces.

    Stretches of a line that hold any other character need not be cut.
    """
    each = filed.select("_size", F.explode(F.array_distinct(F.regexp_extract_all("_filed", F.lit("(?s)(.)"), F.lit(1)))).alias("c"))
    first = F.slice(F.array_sort(F.collect_set("c")), 1, LETTERS + 1)
    found = {r[0]: r[1] for r in each.groupBy("_size").agg(first).sort("_size").collect()}
    return {n: "[" + "".join(f"\\x{{{ord(c):x}}}" for c in cs) + "]" if len(cs) <= LETTERS else "." for n, cs in found.items()}


def _pieces(lines: DataFrame, text: str, letters: dict[int, str], blooms: DataFrame, blocks: int) -> DataFrame:
    """Lines with each of the pieces of their text that the filter may hold, as ``_gram``."""
    cuts = [_grams(F.col(text), n, c) for n, c in letters.items()]
    cut = lines.select("*", F.explode(F.concat(*cuts)).alias("_gram"))
    return bloom.may_be_in(cut, F.xxhash64("secao", "_gram"), blooms, blocks)


def _anchors(lines: DataFrame, text: str, letters: dict[int, str], filed: DataFrame) -> DataFrame:
    """Needles (secao, _filed, _size) with the piece that the fewest lines hold, and its surroundings.

    ``_stretch`` is the piece with up to EDGE characters of the needle on either side, ``_left``
    and ``_right`` of them. Needles with a piece that no line holds are in no line, and left out.
    """
    cuts = [F.when(F.col("_size") == n, _grams(F.col("_filed"), n, c)).otherwise(F.array()) for n, c in letters.items()]
    cut = filed.select("secao", "_filed", F.explode(F.concat(*cuts)).alias("_gram"))
    # The expression also cuts inside letters outside the basic plane; such pieces are in no text.
    grams = sizing.stage(cut.where(F.contains("_filed", "_gram")), "grams")
    blocks = bloom.blocks_for(grams.count())
    blooms = bloom.bloom_filter(grams, F.xxhash64("secao", "_gram"), blocks)
    seen = _pieces(lines.select("secao", text), text, letters, blooms, blocks)
    counts = seen.groupBy("secao", "_gram").agg(F.count(F.lit(1)).alias("_lines"))
    known = grams.join(counts, ["secao", "_gram"], "left").groupBy("secao", "_filed").agg(
        F.min_by("_gram", F.struct("_lines", "_gram")).alias("_gram"), F.count_if(F.col("_lines").isNull()).alias("_absent")
    )
    before = F.instr("_filed", F.col("_gram")) - 1
    after = F.length("_filed") - before - F.length("_gram")
    placed = known.where("_absent = 0").select(
        "secao", "_filed", "_gram", F.least(before, F.lit(EDGE)).alias("_left"), F.least(after, F.lit(EDGE)).alias("_right"), before.alias("_before")
    )
    stretch = F.substring("_filed", F.col("_before") - F.col("_left") + 1, F.col("_left") + F.length("_gram") + F.col("_right"))
    return sizing.stage(placed.withColumn("_stretch", stretch).drop("_before"), "anchors")


def _stretches(lines: DataFrame, text: str, letters: dict[int, str], anchors: DataFrame, n_anchors: int) -> DataFrame:
    """Lines with each ``_stretch`` of the anchors that their text holds, and its ``_left``.

    Every place of a filed piece is widened in the ways in which needles under such pieces are,
    and what the filter of stretches may hold leaves the scan, once a line. A few rows are no
    anchor's; a join with the anchors tells them.
    """
    blocks = bloom.blocks_for(n_anchors)
    gram, stretch = F.xxhash64("secao", "_gram"), F.xxhash64("secao", "_left", "_stretch")
    shape = (F.col("_left") * (EDGE + 1) + F.col("_right")).alias("_shape")
    bucket = F.pmod(gram, F.lit(BUCKETS)).cast("int").alias("_bucket")
    shapes = anchors.select(bucket, shape).groupBy("_bucket").agg(F.collect_set("_shape").alias("_shapes"))

    # A piece with all that may surround it. Lines have no line breaks, so that none is taken for text.
    padded = lines.withColumn("_padded", F.concat(F.lit("\n" * EDGE), F.col(text)))
    cuts = [_grams(F.col("_padded"), n, c, EDGE) if n == GRAM else _grams(F.col(text), n, c) for n, c in letters.items()]
    window, left, right = F.col("_window"), F.floor(F.col("_shape") / (EDGE + 1)).cast("int"), F.col("_shape") % (EDGE + 1)
    short = F.length(window) < GRAM
    cut = padded.select("*", F.explode(F.concat(*cuts)).alias("_window"))
    cut = cut.withColumn("_gram", F.when(short, window).otherwise(F.substring(window, EDGE + 1, GRAM)))
    seen = bloom.may_be_in(cut, gram, bloom.bloom_filter(anchors, gram, blocks), blocks)
    shaped = seen.select("*", bucket).join(F.broadcast(shapes), "_bucket").select("*", F.explode("_shapes").alias("_shape"))
    shaped = shaped.where(F.when(short, F.col("_shape") == 0).otherwise(F.length(window) >= EDGE + GRAM + right))
    widened = F.when(short, window).otherwise(F.substring(window, EDGE + 1 - left, left + GRAM + right))
    shaped = shaped.withColumns({"_left": left, "_stretch": widened})
    likely = bloom.may_be_in(shaped, stretch, bloom.bloom_filter(anchors, stretch, blocks), blocks)
    # Of equal stretches of a line the first counts; its surroundings tell which that is.
    first = F.substring("_padded", F.instr(text, F.col("_stretch")) + F.col("_left"), F.lit(EDGE + GRAM + EDGE))
    counts = F.contains(F.col(text), F.col("_stretch")) & (short | (window == first))
    return where_present(likely, "_counts", F.when(counts, True)).select(*lines.columns, "_left", "_stretch")


def _held(lines: DataFrame, text: str, wanted: DataFrame) -> DataFrame | None:
    """Lines with each row of ``wanted`` of their section whose ``_needle`` their text holds; None if nothing is wanted.

    A needle that is no longer than its stretch is known by that, and lines meet it without
    their text. Only for longer ones the text is exchanged, with lines that hold the stretch.
    """
    size = F.least(F.length("_filed"), F.lit(GRAM))
    filed = wanted.select("secao", F.col("_needle").alias("_filed")).distinct().withColumn("_size", size)
    letters = _letters(filed)
    if not letters:
        return None
    anchors = _anchors(lines, text, letters, filed).withColumnRenamed("_filed", "_needle")
    is_whole = F.col("_needle") == F.col("_stretch")
    n_whole, n_longer = anchors.agg(F.count_if(is_whole), F.count_if(~is_whole)).first()

    whole = anchors.where(is_whole)
    met = _stretches(lines, text, letters, whole, n_whole).withColumnRenamed("_stretch", "_needle")
    placed = wanted.join(whole.select("secao", "_needle", "_left"), ["secao", "_needle"])
    met = met.join(placed, ["secao", "_needle", "_left"]).drop("_left")
    if not n_longer:
        return met
    longer = anchors.where(~is_whole)
    rest = _stretches(lines, text, {GRAM: letters[GRAM]}, longer, n_longer)
    rest = rest.join(longer.select("secao", "_needle", "_left", "_stretch"), ["secao", "_left", "_stretch"])
    rest = rest.where(F.contains(F.col(text), F.col("_needle"))).drop("_left", "_stretch")
    return met.unionByName(rest.join(wanted, ["secao", "_needle"]))


def _indexed(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """Lines with the needles that they hold, through an index of the needles' rarest pieces."""
    wanted = sizing.stage(wanted.where("secao IS NOT NULL"), "needles")
    # What has no text to look for meets every line of its section, or the first one of each file.
    found = sizing.join_rules(lines, wanted.where("_needle = ''"), holds(), "inner")
    met = _held(lines, "_folded", wanted.where("_needle <> '' AND _pattern IS NULL"))
    if met is not None:
        found = found.unionByName(met)
    patterns = wanted.where("_needle <> '' AND _pattern IS NOT NULL")
    # Many rules may have one pattern: a line is tested once for all of them, and meets them without its text.
    each = patterns.select("secao", "_needle", "_pattern").distinct()
    # Lines are folded once each, not once for every piece and needle that they meet.
    met = _held(lines.withColumn("_loose", loosely(F.col("line"))), "_loose", each)
    if met is not None:
        met = met.drop("_loose").where(F.call_function("rlike", F.col("line"), F.col("_pattern")))
        found = found.unionByName(met.join(patterns, ["secao", "_needle", "_pattern"]))
    return found
