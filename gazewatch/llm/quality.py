"""Quality rules: one table of thresholds compiled into one Spark projection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazewatch.llm.common import BLANK_CLASS, blank_words

SYMBOLS = "#*$%&|<>"
WINDOW = 8

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the and of to a in is it that for on with as by at from be or an are this was not but "
    "le la les de des et un une du que qui dans en est pour pas sur au avec par ce il elle "
    "der die das und ist nicht ein eine zu mit von den auf sich für als auch dem es "
    "el los las y se del por con para una su al lo como más o no"
).split()


@dataclass(frozen=True)
class Rule:
    """Reject a document whose `metric` lies outside [low, high] (None: no bound)."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None


#: Ratios are to the number of words, of non-blank lines for dup_line_ratio.
RULES = (
    Rule("length", "n_words", low=20),
    Rule("word_length", "mean_word_chars", low=2.5, high=12),
    Rule("symbols", "symbol_ratio", high=0.25),
    Rule("stop_words", "stop_ratio", low=0.05),
    Rule("duplicate_lines", "dup_line_ratio", high=0.6),
    Rule("repetition", "repeat_ratio", high=0.3),
)


def _let(value: Column, body) -> Column:
    """`body(value)` with the value computed once, also where the body's lambdas use it."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """How many words lie in windows that occur twice or more in the array.

    Windows are compared by 64-bit hashes within one text. Sorted hashes show whether
    any repeats; only then are the places sorted with them and the covered words
    added up from one place to the next, so the cost is n log n for any text.
    """

    def covered(places: Column) -> Column:
        steps = F.transform(
            places,
            lambda p, i: F.when(i + 1 < F.size(places), F.get(places, i + 1) - p).otherwise(window),
        )
        return F.aggregate(
            steps, F.lit(0).cast("long"), lambda total, s: total + F.least(s, F.lit(window))
        )

    def places(hashes: Column) -> Column:
        def repeated(pairs: Column) -> Column:
            same = lambda e, j: F.coalesce(F.get(pairs, j)["h"] == e["h"], F.lit(False))
            kept = F.filter(pairs, lambda e, i: same(e, i - 1) | same(e, i + 1))
            return F.array_sort(F.transform(kept, lambda e: e["i"]))

        pairs = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        return _let(F.sort_array(pairs), repeated)

    def count(hashes: Column) -> Column:
        return F.when(
            F.size(F.array_distinct(hashes)) < F.size(hashes), _let(places(hashes), covered)
        ).otherwise(F.lit(0).cast("long"))

    def windows(hashed: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(hashed) - (window - 1))
        return F.transform(starts, lambda i: F.xxhash64(F.slice(hashed, i, window)))

    several = _let(F.transform(words, lambda w: F.xxhash64(w)), windows)
    return F.when(F.size(words) <= window, F.lit(0).cast("long")).otherwise(_let(several, count))


def measured(docs: DataFrame, text: str = "text", passed: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The passed columns of every row and its metrics; a null text counts as empty."""
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        *[F.col(c) for c in passed],
        whole.alias("_text"),
        blank_words(F.col(text)).alias("_words"),
        F.filter(F.split(whole, "\n"), lambda s: s.rlike("[^\\x20\\x09-\\x0D]")).alias("_lines"),
    )
    stops = F.filter(
        F.col("_words"), lambda w: F.rtrim(F.lower(w), F.lit(".,;:!?")).isin(STOP_WORDS)
    )
    counted = rows.select(
        *[F.col(c) for c in passed],
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.regexp_replace("_text", BLANK_CLASS + "+", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_text", f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size(stops).cast("long").alias("n_stop_words"),
        repeated_words(F.col("_words")).alias("n_repeat_words"),
    )
    per_word = lambda c: F.coalesce(F.col(c) / F.nullif(F.col("n_words"), F.lit(0)), F.lit(0.0))
    return counted.withColumns(
        {
            "mean_word_chars": per_word("word_chars"),
            "symbol_ratio": per_word("n_symbols"),
            "stop_ratio": per_word("n_stop_words"),
            "repeat_ratio": per_word("n_repeat_words"),
            "dup_line_ratio": F.coalesce(
                F.col("n_dup_lines") / F.nullif(F.col("n_lines"), F.lit(0)), F.lit(0.0)
            ),
        }
    )


def broken(rules: tuple[Rule, ...] = RULES) -> Column:
    """The names of the rules that a measured row breaks, in the order of the table."""
    tests = []
    for rule in rules:
        bad = F.lit(False)
        if rule.low is not None:
            bad = bad | (F.col(rule.metric) < rule.low)
        if rule.high is not None:
            bad = bad | (F.col(rule.metric) > rule.high)
        tests.append(F.when(bad, F.lit(rule.name)))
    return F.array_compact(F.array(*tests))


def keep(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The rows that judge() keeps, with all their columns.

    The filter asks for a row number too, which keeps the verdict in one projection: over
    plain expressions it would be handed down with every metric written out at each use.
    """
    inner = {c: f"_in_{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select(*[F.col(c).alias(name) for c, name in inner.items()])
    judged = judge(rows, rules, inner[text], tuple(inner.values()))
    judged = judged.select(*inner.values(), "kept", F.monotonically_increasing_id().alias("_row"))
    return judged.where("kept AND _row >= 0").select(*[F.col(name).alias(c) for c, name in inner.items()])


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", passed=("doc_id",)) -> DataFrame:
    """The passed columns of every row, its metrics, `base_failed`, `broken` and `kept`.

    One narrow projection: no shuffle, no join, no Python. Every input row gives one row,
    repeated rows too. Null, empty and blank texts have no words, fail the base rule and
    are not kept. Other columns of the input are not read, whatever their names.
    """
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return (
        measured(docs, text, tuple(passed))
        .withColumns({"base_failed": base, "broken": broken(rules)})
        .withColumn("kept", ~F.col("base_failed") & (F.size("broken") == 0))
    )
