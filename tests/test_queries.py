"""Every registered query with SQL against DuckDB on the smallest tables."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry
from check import TABLES, rows_of

SF = "/root/testdata/sf0.001"
ORACLE = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    relation = con.execute(ORACLE[name])
    columns = [d[0] for d in relation.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, relation.fetchall())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(entry.queries())
