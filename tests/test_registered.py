"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry_points
from oracle import difference

FOLDER = "/root/testdata/sf0.001"
SQL = entry_points.oracle_sql()
QUERIES = entry_points.queries()


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, name):
    assert difference(spark, FOLDER, QUERIES[name], SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_has_rows(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    rows = entry_points.entry(spark).collect()
    assert rows and {"query_id", "n_docs", "context"} == set(rows[0].asDict())
