"""Every query runs; those with SQL give what DuckDB gives."""

import pytest

from tessera.plans import catalog
from tests.oracle import compare, connection

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con(data):
    return connection(data)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, data, con, name):
    compare(con, QUERIES[name](spark, data), SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, data, name):
    frame = QUERIES[name](spark, data)
    assert frame.columns and frame.count() > 0


def test_entry(spark, data):
    assert catalog.entry(spark, data).columns == ["brand", "left_name", "right_name", "score"]


def test_sql_has_queries():
    assert set(SQL) <= set(QUERIES)
