"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazewatch.llm import bpe, conversation, fim, iblt, language, licenses, mixing, near_dedup, packing, quality, suffix_dedup, unigram, window_dedup
from gazewatch.llm.common import table

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(query: Callable[[SparkSession, str], DataFrame]):
    REGISTRY[query.__name__] = query
    return query


def vocabulary(name: str) -> str:
    """Where a public vocabulary file lies; executors have the same installation."""
    import public_tokenizers

    return public_tokenizers.path(name)


@register
def op1_difference_cover_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window_dedup.remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")
    )


@register
def op2_odd_sketch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def packed_pieces(docs: DataFrame) -> DataFrame:
    """The pieces of packed sequences, with a checksum in place of their ids."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json")).select(
        "doc_id",
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
    )


@register
def op3_lexical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_pieces(table(spark, sf_dir, "documents"))


@register
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify_documents(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "declared", "language", "probability", "kept"
    )


@register
def op4_language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify_pages(table(spark, sf_dir, "pages")).select(
        F.col("id").alias("page_id"), "declared", "suffix", "host", "language", "probability", "kept"
    )


@register
def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


@register
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = bpe.count_tokens(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 2048)


@register
def op7_unigram_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram.piece_counts(spark, table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


@register
def op8_iblt_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iblt.fingerprints(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        "near_edited",
        "near_next",
        "next_id",
    )


@register
def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


@register
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
    )


@register
def op11_chunk_memo_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.transform(table(spark, sf_dir, "documents"))
    back = fim.restored(F.col("output"), F.col("form"))
    return made.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(back, 256).alias("restored_sha256"),
    )


@register
def op12_fair_queue_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"))


@register
def op13_run_length_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = table(spark, sf_dir, "conversations")
    return conversation.report(conversation.damaged(every), every)
