"""The corpus pipeline: five stages, each over all that the one before it kept.

Every stage takes (spark, docs, sf_dir), and docs with the columns of `documents`. All but
the last return those columns; each is written as Parquet and read again for the next.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazewatch.llm import language, near_dedup, packing, quality, suffix_dedup
from gazewatch.llm.common import checkpoint_folder, table
from gazewatch.llm.queries import packed_pieces

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Shingles of five words and a similarity of 0.8, as stages use them throughout.
STAGE_SHINGLE, STAGE_PERCENT = 5, 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the threshold table. The verdict is one projection beside the row.

    Null, empty and blank texts are rejected; repeated rows are judged alike; an empty table
    gives an empty one; other columns than those of documents are dropped.
    """
    return quality.keep(docs.select(*COLUMNS))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with confidence; the rest go.

    Null and empty texts are told by declaration and host alone, if at all. Repeated rows are
    judged alike and count as often in the priors. An empty table gives an empty one.
    """
    return language.keep_identified(docs.select(*COLUMNS)).select(*COLUMNS)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id.

    Texts without words are near copies of nothing. Rows without an id stay. Of rows with equal
    id and text the one with the least other columns stays, so a repeated run keeps the same.
    """
    docs = docs.select(*COLUMNS)
    judged = near_dedup.near_duplicates(docs, percent=STAGE_PERCENT, width=STAGE_SHINGLE)
    gone = judged.where("NOT kept").select("doc_id").distinct()
    kept = docs.join(gone, "doc_id", "left_anti")
    # Rows that share an id are one node; of those with one text the least stays for all. They
    # lie where the join has put them, so texts are exchanged once.
    others = [c for c in COLUMNS if c not in ("doc_id", "text")]
    least = kept.groupBy("doc_id", "text").agg(F.min(F.struct(*others)).alias("_least"))
    return least.select("doc_id", "text", "_least.*").select(*COLUMNS)


def suffix_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of 200-byte strings; the first copy of each stays whole."""
    docs = docs.select(*COLUMNS)
    passed = [c for c in COLUMNS if c not in ("doc_id", "text")]
    left = suffix_dedup.remove_repeats(docs, keep_first=True, whole_chars=True, carry=tuple(passed))
    text = F.decode("kept", "UTF-8")
    return left.withColumns({"text": text, "n_chars": F.length(text).cast("long")}).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 1024 ids over all documents that are left.

    A null text has its closing id only; repeated rows are packed like others; an empty table
    gives no sequences.
    """
    return packed_pieces(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("near_dedup", near_dedup_stage),
    ("suffix_dedup", suffix_dedup_stage),
    ("packing", packing_stage),
]

#: Components, trigram likelihoods and token ids have no SQL form; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to `documents`, each written to the shared folder and read again."""
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4()}"
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
