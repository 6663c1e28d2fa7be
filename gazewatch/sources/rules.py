"""Filter rules: which keywords of which organisation to look for in which section."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from gazewatch import fixed, schemas
from gazewatch.functions import dates as D
from gazewatch.functions import sizing
from gazewatch.functions import text as X


# A keyword that begins so is a regular expression.
PATTERN_PREFIX = "re:"


@dataclass(frozen=True)
class FilterRule:
    nome: str
    secao: str
    orgao: str
    keywords: tuple[str, ...]


SHIPPED = tuple(FilterRule(*row) for row in fixed.SHIPPED_RULES)


def rules_frame(spark: SparkSession, rules: Iterable[FilterRule] = SHIPPED) -> DataFrame:
    """Rules as a table; their order is the order of the rows given."""
    rows = [(i, r.nome, r.secao, r.orgao, list(r.keywords)) for i, r in enumerate(rules)]
    return checked(small_frame(spark, rows, schemas.RULES))


def small_frame(spark: SparkSession, rows: list[tuple], schema: T.StructType) -> DataFrame:
    """A few rows as part of the plan itself, so that using them takes no Python worker."""
    columns = list(zip(*rows)) if rows else [[] for _ in schema.names]
    types = to_arrow_schema(schema)
    table = pa.table([pa.array(c, t.type) for c, t in zip(columns, types)], schema=types)
    return spark.createDataFrame(table, schema)


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rules kept as JSON rows."""
    return checked(spark.read.schema(schemas.RULES).json(path))


def checked(rules: DataFrame) -> DataFrame:
    """Fail on a keyword that is blank, and on any needle that spans lines: text is searched by line."""
    line_break = F.lit("\n")
    bad = F.contains(F.col("orgao"), line_break) | F.exists(
        "keywords",
        lambda k: X.is_blank(k) | F.contains(k, line_break) | (X.strip(k) == F.lit(PATTERN_PREFIX)),
    )
    message = F.concat(F.lit("blank or multi-line needle in rule "), F.col("nome"))
    return rules.withColumn(
        "keywords", F.when(bad, F.raise_error(message)).otherwise(F.col("keywords"))
    )


def keywords(rules: DataFrame) -> DataFrame:
    """One row per rule and keyword."""
    return rules.select(
        "filter_ord",
        "nome",
        "secao",
        "orgao",
        F.posexplode("keywords").alias("keyword_ord", "keyword"),
    )


def rule_dates(rules: DataFrame, targets: DataFrame, lookback: int) -> DataFrame:
    """The work list of runs: for every rule and target day of its section the days to check.

    ``targets`` is ``(secao, target_date)``. Days ascend within each window.
    """
    window = D.days_between(F.date_sub("target_date", lookback), F.col("target_date"))
    pairs = sizing.join_rules(targets, rules.drop("keywords", "orgao"), F.lit(True), "inner")
    return pairs.withColumn("check_date", F.explode(window))
