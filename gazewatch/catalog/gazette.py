"""A gazette derived from the ``orders`` table: every order becomes one act or part of one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gazewatch.functions.sizing import stage
from gazewatch.operators.numbering import ordered_rank
from gazewatch.sources.rules import SHIPPED, FilterRule

MONTHS = (
    "JANEIRO,FEVEREIRO,MARÇO,ABRIL,MAIO,JUNHO,JULHO,AGOSTO,SETEMBRO,OUTUBRO,NOVEMBRO,DEZEMBRO"
)
# Orders per numbering piece.
ORDER_TILE = 32_768

RULES = (
    *SHIPPED,
    FilterRule("Atos-Gerais", "DO1", "Diretoria Colegiada", ("resolve", "retificação da portaria")),
    FilterRule("Atos-Secao2", "DO2", "Agência Nacional", ("SUFER", "deliberação")),
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _acts(spark: SparkSession, folder: str) -> DataFrame:
    key, month = F.col("o_orderkey"), F.month("o_orderdate")
    kind = F.element_at(
        F.array(*[F.lit(v) for v in "zip zip zipE pdf zip zip zipE pdfA".split()]),
        (F.pmod(key, F.lit(8)) + 1).cast("int"),
    )
    day = F.make_date(F.year("o_orderdate"), month, 1 + F.pmod(F.day("o_orderdate"), F.lit(3)))
    section = (F.pmod(F.col("o_custkey"), F.lit(3)) + 1).cast("string")
    return (
        table(spark, folder, "orders")
        .select(
            key.alias("k"),
            day.alias("edition_date"),
            section.alias("sec"),
            kind.alias("v"),
            month.alias("m"),
            F.col("o_orderpriority").alias("priority"),
            F.col("o_orderstatus").alias("status"),
        )
        .where(~((F.col("m") % 4 == 0) & F.col("v").startswith("zip")))
    )


def _file_columns() -> list[Column]:
    dashed = F.col("edition_date").cast("string")
    scored = F.replace(dashed, F.lit("-"), F.lit("_"))
    sec, v = F.col("sec"), F.col("v")
    name = (
        F.when(v == "zip", F.concat(dashed, F.lit("-DO"), sec, F.lit(".zip")))
        .when(v == "zipE", F.concat(dashed, F.lit("-DO"), sec, F.lit("E.zip")))
        .when(v == "pdf", F.concat(scored, F.lit("_ASSINADO_do"), sec, F.lit(".pdf")))
        .otherwise(F.concat(scored, F.lit("_ASSINADO_do"), sec, F.lit("_extra_A.pdf")))
    )
    return [
        name.alias("file_name"),
        F.concat(F.lit("DO"), sec).alias("secao"),
        F.col("edition_date"),
    ]


# What names a file, as short values: names are put together once per file, not per order.
EDITION = ("edition_date", "sec", "v")


def files(spark: SparkSession, folder: str) -> DataFrame:
    """The edition files of the gazette: at most four kinds per day and section.

    Names are put together after the orders are reduced, and filters on names stay there.
    """
    kinds = _acts(spark, folder).groupBy("edition_date", "sec").agg(F.collect_set("v").alias("kinds"))
    return kinds.withColumn("v", F.explode("kinds")).select(*_file_columns())


def _title() -> Column:
    k = F.col("k")
    head = F.element_at(
        F.array(
            *[
                F.lit(h)
                for h in (
                    "DECISÃO SUROD",
                    "PORTARIA ANTT",
                    "DELIBERAÇÃO DG",
                    "INSTRUÇÃO NORMATIVA SUFER",
                    "RETIFICAÇÃO DA PORTARIA",
                )
            ]
        ),
        (F.pmod(k, F.lit(5)) + 1).cast("int"),
    )
    month = F.element_at(F.split(F.lit(MONTHS), ","), F.col("m"))
    return F.concat(
        head,
        F.lit(" Nº "),
        (F.pmod(k, F.lit(9)) + 1).cast("string"),
        F.lit(", DE "),
        F.substring(F.col("edition_date").cast("string"), 9, 2),
        F.lit(" DE "),
        month,
        F.lit(" DE "),
        F.substring(F.col("edition_date").cast("string"), 1, 4),
    )


def _body() -> Column:
    who = (
        F.when(
            F.col("priority") == "1-URGENT",
            "A Agência Nacional de Transportes Terrestres resolve",
        )
        .when(F.col("priority") == "5-LOW", "A Diretoria Colegiada resolve")
        .otherwise("Texto do ato")
    )
    what = (
        F.when(F.col("status") == "F", "SUFER")
        .when(F.col("status") == "O", "portaria e deliberação")
        .otherwise("retificação")
    )
    return F.concat(who, F.lit(" "), what, F.lit(" item "), F.col("k").cast("string"))


def lines(spark: SparkSession, folder: str) -> DataFrame:
    """The gazette as numbered lines: a title line for every third order, a body line for each.

    Line numbers come from counts per piece of orders, so an edition that holds a
    third of all orders is numbered by many tasks.
    """
    acts = _acts(spark, folder)
    titled = F.pmod(F.col("k"), F.lit(3)) == 0
    first = F.when(titled, 0).otherwise(1)
    cut = acts.withColumn("tile", F.floor(F.col("k") / ORDER_TILE)).withColumn(
        "at", F.explode(F.sequence(first, F.lit(1)))
    )
    # Lines are numbered as short rows; the text is written afterwards.
    numbered = ordered_rank(cut, EDITION, ["tile"], ["k", "at"], "line_no", "n_lines")
    line = F.when(F.col("at") == 0, _title()).otherwise(_body())
    return numbered.select(*_file_columns(), "n_lines", "line_no", line.alias("line"))


def staged_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The same, written once for queries that scan the lines several times."""
    return stage(lines(spark, folder), "gazette")
