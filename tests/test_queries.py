"""Every registered query that has SQL gives the same rows as DuckDB over the smallest tables."""

import pytest
from oracle import difference

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", [k for k in entry.queries() if k in entry.oracle_sql()])
def test_query_equals_sql(spark, name):
    assert difference(spark, SMALL, name).startswith("equal")


@pytest.mark.parametrize("name", [k for k in entry.queries() if k not in entry.oracle_sql()])
def test_query_runs(spark, name):
    df = entry.queries()[name](spark, SMALL)
    assert df.columns and len(df.collect()) >= 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
