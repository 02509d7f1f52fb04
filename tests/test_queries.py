"""Every registered query runs without cross joins or row-wise Python and gives the same rows as its SQL in DuckDB."""

import pytest

from check import compare, connect
from impactlens.catalog import QUERIES, SQL


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    plan = df._jdf.queryExecution().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert bad not in plan
    assert compare(df, con, SQL[name]) is None


def test_sql_names_are_queries():
    assert set(SQL) == set(QUERIES)
