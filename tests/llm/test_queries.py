"""The registered corpus queries run; those with SQL give what DuckDB gives."""

import pytest

from tessera.llm import queries
from tests.oracle import compare, connection

QUERIES, SQL = queries.queries(), queries.oracle_sql()


@pytest.fixture(scope="module")
def con(data):
    return connection(data)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, data, con, name):
    compare(con, QUERIES[name](spark, data), SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0
