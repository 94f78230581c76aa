"""Every registered query with SQL against DuckDB on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import TABLES, compare
from workload.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return
    rel = duck.execute(sql)
    cols = [d[0] for d in rel.description]
    assert compare(rows, df.columns, rel.fetchall(), cols) is None


def test_contract():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 90
