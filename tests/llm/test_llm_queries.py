"""Every registered query over whole tables, next to its SQL where it has one."""

from __future__ import annotations

import compare
import pytest

from gazewatch.llm.oracle import ORACLE
from gazewatch.llm.queries import REGISTRY

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return compare.views(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, con, name):
    problem, _, _ = compare.check(spark, con, FOLDER, name, REGISTRY[name], ORACLE[name])
    assert problem is None


@pytest.mark.parametrize("name", sorted(set(REGISTRY) - set(ORACLE)))
def test_query_gives_every_row(spark, name):
    of = {"op4_language_id_pages": ("pages", "page_id"), "op13_run_length_repair": ("conversations", "conv_id")}
    table, key = of.get(name, ("documents", "doc_id"))
    rows = spark.read.parquet(f"{FOLDER}/{table}.parquet").select(key).distinct().count()
    assert REGISTRY[name](spark, FOLDER).select(key).distinct().count() == rows


def test_there_is_a_query_for_each_operator():
    assert {int(name[2:].split("_")[0]) for name in REGISTRY} == set(range(1, 14))
