"""Training-data queries with SQL agree with DuckDB, value by value."""

import pytest

import check_queries
from reviewmill.llm.oracle import ORACLE
from reviewmill.llm.queries import QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_agrees_with_duckdb(spark, sf_dir, name, monkeypatch):
    monkeypatch.setattr(check_queries, "QUERIES", QUERIES)
    monkeypatch.setattr(check_queries, "ORACLE", ORACLE)
    problem, n = check_queries.difference(spark, check_queries.connect(sf_dir), sf_dir, name)
    assert problem == "" and n > 0
