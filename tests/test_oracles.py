"""Every query of the core against its DuckDB SQL."""

from __future__ import annotations

import os

import duckdb
import pytest

from corpusrank.plans import catalog


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for f in os.listdir(data):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{data}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_rows(spark, data, duck, name):
    ours, theirs = catalog.QUERIES[name](spark, data).toPandas(), duck.sql(catalog.SQL[name]).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    a, b = (x[columns].sort_values(columns).reset_index(drop=True) for x in (ours, theirs))
    assert len(a) == len(b)
    for c in columns:
        assert (a[c] == b[c]).all(), c


def test_every_oracle_has_a_query():
    assert set(catalog.SQL) <= set(catalog.QUERIES)


def test_queries_without_sql_run(spark, data):
    for name in sorted(set(catalog.QUERIES) - set(catalog.SQL)):
        assert catalog.QUERIES[name](spark, data).count() > 0, name


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
