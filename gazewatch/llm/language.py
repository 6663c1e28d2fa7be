"""Language identification by fusing text, declared language, address suffix and host.

For a row r and a language l, log P(l | r) adds up
* the log likelihood of the text's hashed byte trigrams under l, tempered by EVIDENCE,
  since neighbouring trigrams are not independent;
* the log probability that a row of language l declares what r declares;
* the log prior of l on the row's host, smoothed towards its address suffix, which is
  smoothed towards all rows. A row's own declaration is left out of its prior.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazewatch.functions.sizing import fits_broadcast
from gazewatch.llm.common import checkpointed, slices
from gazewatch.llm.hashing import mixed

LANGUAGES = ("en", "de", "fr", "es")
BUCKETS = 1 << 14
BATCH_BYTES = 500_000
#: Weight of one trigram's log likelihood, and the most trigrams that count.
EVIDENCE, MOST_GRAMS = 0.1, 400
#: How often a declaration is right.
DECLARED_RIGHT = 0.9
#: Rows that a suffix and a host must have for their own counts to weigh half.
SUFFIX_WEIGHT, HOST_WEIGHT = 50.0, 20.0
#: A row is kept if its language is this probable and its text fits it this much better,
#: per trigram, than trigrams spread evenly over all buckets.
LEAST_POSTERIOR, LEAST_FIT = 0.5, 0.5


def _grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Trigram buckets of some texts, one after the other, and where each text's begin and the end.

    Letters A-Z are folded. Digits and other ASCII signs count as blanks, and trigrams of
    blanks only do not count, so markup and numbers say nothing.
    """
    # Two blanks before each text and after the last: no trigram has letters of two texts.
    data = np.frombuffer(b"  ".join([b"", *texts, b""]), dtype=np.uint8)
    letters = data | np.uint8(0x20)
    plain = np.where((letters >= 97) & (letters <= 122), letters, np.where(data >= 128, data, np.uint8(32)))
    wide = plain.astype(np.uint64)
    code = (wide[:-2] << np.uint64(16)) | (wide[1:-1] << np.uint64(8)) | wide[2:] if len(wide) > 2 else wide[:0]
    buckets = (mixed(code) >> np.uint64(50)).astype(np.int64)
    limits = np.concatenate(([0], np.cumsum([len(t) + 2 for t in texts]))).astype(np.int64)
    counts = code != 0x202020
    at = np.flatnonzero(counts)
    return buckets[at], np.searchsorted(at, limits)


def gram_counts(rows: DataFrame, languages: tuple[str, ...]) -> DataFrame:
    """lang, bucket, n over all rows that declare one of the languages: at most that many sums."""

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages), BUCKETS), dtype=np.int64)
        for batch in slices(batches, "text", BATCH_BYTES):
            texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            buckets, limits = _grams(texts)
            index = {name: i for i, name in enumerate(languages)}
            declared = np.array([index.get(d, -1) for d in batch.column("declared").to_pylist()], dtype=np.int64)
            owner = np.repeat(declared, np.diff(limits))
            known = owner >= 0
            total += np.bincount(owner[known] * BUCKETS + buckets[known], minlength=total.size).reshape(total.shape)
        lang, bucket = np.nonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(lang.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(total[lang, bucket])],
            names=["lang", "bucket", "n"],
        )

    sums = rows.select("declared", "text").mapInArrow(counted, "lang int, bucket int, n long")
    return sums.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def log_likelihoods(rows: DataFrame, languages: tuple[str, ...]) -> np.ndarray:
    """The smoothed log probability of each bucket in each language, a table of fixed size.

    Its size is languages times BUCKETS, whatever the input, so it may pass the driver.
    """
    table = np.ones((len(languages), BUCKETS))
    counts = gram_counts(rows, languages).toPandas()
    table[counts["lang"], counts["bucket"]] += counts["n"]
    return np.log(table / table.sum(axis=1, keepdims=True))


def _scored(rows: DataFrame, model: np.ndarray, languages: tuple[str, ...]) -> DataFrame:
    """The rows' other columns with n_grams and the mean log likelihood of each language."""
    columns = [c for c in rows.columns if c != "text"]
    fields = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in columns)

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", BATCH_BYTES):
            texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            buckets, limits = _grams(texts)
            n = np.diff(limits)
            means = []
            for of_language in model:
                sums = np.concatenate(([0.0], np.cumsum(of_language[buckets])))
                means.append((sums[limits[1:]] - sums[limits[:-1]]) / np.maximum(n, 1))
            means = np.round(np.stack(means, axis=1), 9)
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(len(texts) + 1) * len(languages), pa.int32()), pa.array(means.ravel())
            )
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in columns], pa.array(n.astype(np.int64)), lists],
                names=[*columns, "n_grams", "fits"],
            )

    return rows.select(*columns, "text").mapInArrow(score, f"{fields}, n_grams long, fits array<double>")


def host_priors(rows: DataFrame, languages: tuple[str, ...]) -> DataFrame:
    """suffix, host and, as arrays by language, the counts of declarations on the host, on the
    suffix and on all rows. Grouped sums only; null hosts and suffixes are groups of their own."""
    counts = lambda c: F.array(*[F.sum(F.when(F.col("declared") == name, c).otherwise(0)) for name in languages])
    add = lambda c: F.array(*[F.sum(F.get(c, i)) for i in range(len(languages))])
    hosts = rows.groupBy("suffix", "host").agg(counts(F.lit(1)).alias("host_n"))
    suffixes = hosts.groupBy("suffix").agg(add(F.col("host_n")).alias("suffix_n"))
    everything = suffixes.agg(add(F.col("suffix_n")).alias("all_n"))
    same = F.col("hosts.suffix").eqNullSafe(F.col("suffixes.suffix"))
    joined = hosts.alias("hosts").join(suffixes.alias("suffixes"), same).select("hosts.*", "suffix_n")
    return joined.crossJoin(F.broadcast(everything))  # one row


def sized(priors: DataFrame) -> DataFrame:
    """The priors, worked out once; a table within the broadcast limits goes to every executor.

    Rows and bytes are counted first. Larger tables are joined by host, where Spark splits
    the rows of a very common one among tasks; the rows that come out are the same.
    """
    priors = checkpointed(priors)
    return F.broadcast(priors) if fits_broadcast(priors) else priors


def posterior(scored: DataFrame, priors: DataFrame, languages: tuple[str, ...]) -> DataFrame:
    """scored with language, probability and kept."""
    n = len(languages)
    same = F.col("r.suffix").eqNullSafe(F.col("p.suffix")) & F.col("r.host").eqNullSafe(F.col("p.host"))
    rows = scored.alias("r").join(priors.alias("p"), same, "left").select("r.*", "host_n", "suffix_n", "all_n")
    own = lambda i: F.when(F.col("declared") == languages[i], 1.0).otherwise(0.0)
    total = lambda c: reduce(lambda a, b: a + b, [F.get(c, i) - own(i) for i in range(n)])

    def prior(i: int) -> Column:
        every = (F.get("all_n", i) - own(i) + 1.0) / (total(F.col("all_n")) + n)
        of_suffix = (F.get("suffix_n", i) - own(i) + SUFFIX_WEIGHT * every) / (total(F.col("suffix_n")) + SUFFIX_WEIGHT)
        return (F.get("host_n", i) - own(i) + HOST_WEIGHT * of_suffix) / (total(F.col("host_n")) + HOST_WEIGHT)

    wrong = (1 - DECLARED_RIGHT) / (n - 1)
    declared = lambda i: F.when(
        F.col("declared").isin(*languages), F.when(F.col("declared") == languages[i], DECLARED_RIGHT).otherwise(wrong)
    ).otherwise(1.0)
    weight = F.least(F.col("n_grams"), F.lit(MOST_GRAMS)) * EVIDENCE
    logs = F.array(*[F.get("fits", i) * weight + F.log(declared(i)) + F.log(prior(i)) for i in range(n)])
    rows = rows.withColumn("logs", logs)
    top = F.array_max("logs")
    rows = rows.withColumn("best", F.array_position("logs", top).cast("int") - 1).withColumn(
        "probability",
        F.round(1.0 / F.aggregate("logs", F.lit(0.0), lambda t, x: t + F.exp(x - F.array_max("logs"))), 6),
    )
    fit = F.get("fits", F.col("best")) + math.log(BUCKETS)
    return rows.withColumns(
        {
            "language": F.when(F.col("n_grams") > 0, F.get(F.array(*map(F.lit, languages)), F.col("best"))),
            "kept": (F.col("n_grams") > 0) & (F.col("probability") >= LEAST_POSTERIOR) & (fit >= LEAST_FIT),
        }
    ).drop("logs", "best", "fits", "host_n", "suffix_n", "all_n")


def identify(
    rows: DataFrame,
    doc_id: str,
    text: Column,
    declared: Column,
    host: Column,
    suffix: Column,
    languages: tuple[str, ...] = LANGUAGES,
) -> DataFrame:
    """id, declared, suffix, host, n_grams, language, probability and kept of every row.

    The text model counts all rows that declare one of `languages`; any other declaration
    and null say nothing. Texts without letters (null and empty ones too) have a null
    language and are not kept. Null hosts and suffixes form groups like others. Text stays
    in its scan: what is joined by host are ids and a few numbers, and a host's counts are
    added up before, so a host with a third of all rows is one row of the priors. Repeated rows
    are judged alike, and each counts; an empty table gives none.
    """
    plain = rows.select(
        F.col(doc_id).alias("id"), declared.alias("declared"), suffix.alias("suffix"), host.alias("host"),
        F.coalesce(text, F.lit("")).alias("text"),
    )
    model = log_likelihoods(plain, languages)
    priors = sized(host_priors(plain, languages))
    return posterior(_scored(plain, model, languages), priors, languages)


def identify_documents(docs: DataFrame) -> DataFrame:
    """identify() for `documents`: lang is what a document declares, its source is its host."""
    return identify(docs, "doc_id", F.col("text"), F.lower("lang"), F.col("source"), F.lit(None).cast("string"))


def keep_identified(docs: DataFrame, languages: tuple[str, ...] = LANGUAGES) -> DataFrame:
    """The rows of `documents`, with all their columns, whose language identify() keeps.

    The scores are put beside the whole rows, which pass by in their scan while the priors
    fit a broadcast; beyond that, they are shuffled by host with their text.
    """
    inner = {c: f"_in_{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select(
        *[F.col(c).alias(name) for c, name in inner.items()],
        F.lower("lang").alias("declared"), F.col("source").alias("host"),
        F.lit(None).cast("string").alias("suffix"), F.coalesce("text", F.lit("")).alias("text"),
    )
    plain = rows.select("declared", "host", "suffix", "text")
    model = log_likelihoods(plain, languages)
    scored = _scored(rows, model, languages)
    judged = posterior(scored, sized(host_priors(plain, languages)), languages)
    return judged.where("kept").select(*[F.col(name).alias(c) for c, name in inner.items()])


def identify_pages(pages: DataFrame) -> DataFrame:
    """identify() for `pages`: the lang attribute, the host and its last label, visible text."""
    html, url = F.coalesce("html", F.lit("")), F.coalesce("url", F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    lang = F.lower(F.regexp_extract(html, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})", 1))
    visible = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    visible = F.regexp_replace(F.regexp_replace(visible, r"(?s)<[^>]*>", " "), r"&[a-zA-Z#0-9]+;", " ")
    empty_to_null = lambda c: F.when(c != "", c)
    return identify(
        pages, "page_id", visible, empty_to_null(lang), empty_to_null(host),
        empty_to_null(F.regexp_extract(host, r"\.([a-z0-9-]+)$", 1)),
    )
