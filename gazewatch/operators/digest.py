"""The digest of a run: numbered matches, one message per run and its items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazewatch import fixed
from gazewatch.functions import dates as D
from gazewatch.operators.acts import WINDOW_TILE
from gazewatch.operators.numbering import ordered_rank

def numbered(matches: DataFrame, run: str = "run_date") -> DataFrame:
    """Number the matches of each run 1, 2, ... by rule, day, file, keyword and line."""
    keyed = matches.withColumn(
        "_file", F.struct("filter_ord", "edition_date", "source_file")
    ).withColumn("_lines", F.struct("keyword_ord", F.floor(F.col("line_no") / WINDOW_TILE)))
    ranked = ordered_rank(keyed, [run], ["_file", "_lines"], ["line_no"], "n", "n_matches")
    return ranked.withColumn("n", F.col("n") + 1).drop("_file", "_lines")


def heading(title: Column, day: Column) -> Column:
    shown = F.when(title == "", F.lit(fixed.NO_TITLE_LABEL)).otherwise(title)
    return F.concat(shown, F.when(day != "", F.concat(F.lit(" — "), day)).otherwise(F.lit("")))


def block(n: Column) -> Column:
    """HTML for one match."""
    return F.concat(
        F.lit(f"<hr/><h3>{fixed.ITEM_LABEL}"),
        n.cast("string"),
        F.lit(" — "),
        heading(F.col("publication_title"), F.col("publication_date")),
        F.lit(f"</h3><p><b>{fixed.FILTER_LABEL}</b> "),
        F.col("filter_name"),
        F.lit(f"</p><p><b>{fixed.KEYWORD_LABEL}</b> <code>"),
        F.col("keyword_hit"),
        F.lit(f"</code></p><p><b>{fixed.SOURCE_LABEL}</b> "),
        F.col("source_file"),
        F.lit("</p><pre>"),
        F.col("text_snippet"),
        F.lit("</pre>"),
    )


def subject(prefix: str, run: Column, n_matches: Column) -> Column:
    tail = F.when(
        n_matches > 0, F.concat(n_matches.cast("string"), F.lit(" achado(s)"))
    ).otherwise(F.lit(f"{fixed.HEARTBEAT_LABEL} (0 achados)"))
    return F.concat(F.lit(prefix + " "), run.cast("string"), F.lit(" — "), tail)


def distinct_sections(rules: DataFrame) -> DataFrame:
    """The sections of all rules as one text, ascending."""
    return rules.agg(F.array_join(F.array_sort(F.collect_set("secao")), ", ").alias("sections"))


def digest(
    numbered_matches: DataFrame,
    prefix: str,
    sections: str,
    lookback: int | None = fixed.LOOKBACK_DAYS,
    run: str = "run_date",
) -> DataFrame:
    """One message per run that has matches: its subject and what comes before and after its items.

    The items are rows of ``digest_items``, between head and foot in the order of ``n``, so
    a run with any number of matches has the same shape and no cell grows with it.
    """
    head = F.concat(
        F.lit("<html><body><h2>" + prefix + " "),
        F.col(run).cast("string"),
        F.lit(f"</h2><p><b>{fixed.TOTAL_LABEL} "),
        F.col("n_matches").cast("string"),
        F.lit("</b></p>"),
    )
    foot = f"<hr/><p>{fixed.WINDOW_LABEL} {window_label(lookback)} | Seções: {sections}</p></body></html>"
    return numbered_matches.select(run, "n_matches").distinct().select(
        run,
        "n_matches",
        subject(prefix, F.col(run), F.col("n_matches")).alias("subject"),
        head.alias("head"),
        F.lit(foot).alias("foot"),
    )


def digest_items(numbered_matches: DataFrame, run: str = "run_date") -> DataFrame:
    """The block of every match, numbered inside its run."""
    return numbered_matches.select(run, "n", block(F.col("n")).alias("block"))


def window_label(lookback: int | None) -> str:
    return ", ".join(f"D-{i}" for i in range(lookback or 0, 0, -1)) + (
        ", D+0" if lookback else "D+0"
    )


def heartbeat(prefix: str, run: Column) -> Column:
    """Body of the message that only says the system is alive."""
    return F.concat(
        F.lit("<html><body><h2>" + prefix + " "),
        run.cast("string"),
        F.lit(f"</h2><p><b>{fixed.HEARTBEAT_LABEL}</b></p><p>{fixed.NO_MATCH_LABEL}</p></body></html>"),
    )


def is_due(
    n_matches: Column, moment: Column, hours: tuple[int, int] = fixed.HEARTBEAT_HOURS
) -> Column:
    """A digest goes out if anything matched, or in the heartbeat window regardless."""
    return (n_matches > 0) | D.is_heartbeat(moment, hours)
