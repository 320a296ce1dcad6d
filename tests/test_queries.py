"""Every registered query against its SQL twin on the smallest tables."""

from pathlib import Path

import pytest

import oracle
from __spark_entry__ import entry, oracle_sql, queries

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="driver tables not present")

QUERIES, SQL = queries(), oracle_sql()


@pytest.fixture(scope="module")
def con():
    return oracle.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, con, name):
    assert oracle.compare(spark, con, FOLDER, QUERIES[name], SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    assert {r["bucket"] for r in entry(spark).collect()} == {"eligible", "needs_review", "excluded", "irrelevant"}
