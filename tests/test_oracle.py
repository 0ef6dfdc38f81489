"""Every query with oracle SQL agrees with DuckDB, value by value."""

import pytest

import __spark_entry__
from check_queries import connect, difference
from reviewmill.plans.catalog import QUERIES
from reviewmill.plans.oracle import ORACLE


@pytest.fixture(scope="module")
def db(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_agrees_with_duckdb(spark, db, sf_dir, name):
    problem, n = difference(spark, db, sf_dir, name)
    assert problem == ""
    assert n > 0


def test_contract(spark):
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert QUERIES.keys() <= __spark_entry__.queries().keys()
    result = __spark_entry__.entry(spark)
    assert result.columns == ["category", "n", "share"]
    assert result.count() > 0
