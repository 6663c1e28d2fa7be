"""Text expressions. Every function takes and returns Spark columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from gazewatch import fixed

# Unicode classes spelled out, so one pattern gives the same matches in every regex engine.
SPACE = (
    r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
WORD = r"[\p{L}\p{N}_]"
DIGIT = r"\p{Nd}"


SHORTHANDS = ((r"\s", SPACE), (r"\w", WORD), (r"\d", DIGIT))


def portable(pattern: str) -> str:
    """Replace the ``\\s \\w \\d`` shorthands by explicit Unicode classes."""
    for shorthand, spelled in SHORTHANDS:
        pattern = pattern.replace(shorthand, spelled)
    return pattern


def strip(text: Column) -> Column:
    """Drop white space at both ends."""
    return F.btrim(text, F.lit(fixed.WHITE_SPACE))


def collapse_space(text: Column) -> Column:
    """Every run of white space becomes one blank; none is left at the ends."""
    return strip(F.regexp_replace(text, SPACE + "+", " "))


def strip_markup(markup: Column) -> Column:
    """Tags become blanks, then white space is collapsed."""
    return collapse_space(F.regexp_replace(markup, "<[^>]+>", " "))


def is_blank(text: Column) -> Column:
    return strip(text) == ""


# The one letter whose folded form is longer than itself.
GROWS = "İ"


def fold(text: Column) -> Column:
    """Case folding used by every search."""
    return F.lower(text)


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def title_tries(
    stripped: Column,
    folded: Column,
    patterns: Sequence[str] = fixed.TITLE_PATTERNS,
    stems: Sequence[str] | None = fixed.TITLE_STEMS,
) -> list[Column]:
    """What each title pattern finds on a stripped line: empty or null if nothing.

    ``folded`` is the same line case-folded. A substring test on it keeps a regular
    expression away from the lines it cannot match.
    """
    odd = any_of([F.contains(stripped, F.lit(c)) for c in fixed.STEM_LOOKALIKES])
    found = [F.regexp_extract(stripped, _literal(p), 1) for p in patterns]
    if stems is None:
        return found
    return [F.when(F.contains(folded, F.lit(s)) | odd, f) for s, f in zip(stems, found)]


def first_title(tries: Sequence[Column]) -> Column:
    """The first title found, or null."""
    return strip(F.coalesce(*[F.when(t != "", t) for t in tries]))


def _literal(pattern: str) -> str:
    # i: any case, u: by Unicode rules, d: only \\n ends a line for '.'
    return f"(?iud)({portable(pattern)})"


def title_date(title_text: Column) -> Column:
    """The date phrase in a title, or the empty string."""
    return F.regexp_extract(title_text, _literal(fixed.DATE_PHRASE), 1)


def snippet(full_text: Column, chars: int = fixed.SNIPPET_CHARS) -> Column:
    return F.substring(full_text, 1, chars)


def untitled_label(full_text: Column, chars: int = fixed.TITLE_CHARS) -> Column:
    """Title of an act without one: how its text begins, on one line."""
    return strip(F.translate(F.substring(full_text, 1, chars), "\n", " "))


def context_snippet(text: Column, position: Column, chars: int = fixed.CONTEXT_CHARS) -> Column:
    """Up to ``chars`` characters on each side of a zero-based position."""
    first = F.greatest(position - chars, F.lit(0))
    return F.substring(text, (first + 1).cast("int"), (position + chars - first).cast("int"))


def keyword_count(text: Column, keyword: str) -> Column:
    """How often a keyword occurs, overlapping occurrences included."""
    return F.regexp_count(fold(text), F.lit(f"(?={quoted(keyword)})"))


def keyword_pieces(text: Column, keyword: str) -> Column:
    """Folded text cut before every occurrence of a keyword.

    Every piece but possibly the first begins where the keyword occurs, so the
    running length of the pieces gives every position, overlapping ones included,
    in one pass over the text.
    """
    return F.split(fold(text), f"(?={quoted(keyword)})", -1)


def quoted(keyword: str) -> str:
    """A regular expression for the folded keyword itself."""
    return r"\Q" + keyword.lower().replace(r"\E", r"\E\\E\Q") + r"\E"


def section_number(secao: str) -> str:
    return secao.replace("DO", "")
