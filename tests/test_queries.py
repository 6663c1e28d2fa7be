import pytest

import compare
from __spark_entry__ import entry, oracle_sql, queries
from gazewatch.catalog.oracle import ORACLE
from gazewatch.catalog.queries import REGISTRY

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return compare.views(FOLDER)


def test_every_query_has_its_sql():
    assert set(REGISTRY) == set(ORACLE)
    assert set(REGISTRY) <= set(queries()) and set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query_equals_sql(spark, con, name):
    problem, _, _ = compare.check(spark, con, FOLDER, name, REGISTRY[name], ORACLE[name])
    assert problem is None


def test_entry(spark):
    assert entry(spark).count() > 200
