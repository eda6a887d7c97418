"""Every registered core query runs; those with a DuckDB twin give the same rows, names and kinds of types."""

import os

import pytest
from compare import compare, connect

from tabulon.plans.catalog import ORACLE_SQL, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, con, name):
    assert compare(QUERIES[name](spark, SF), con, ORACLE_SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    rows = QUERIES[name](spark, SF).limit(5).collect()
    assert rows
