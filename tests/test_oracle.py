"""Every query with SQL against DuckDB on the smallest tables."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")

import __spark_entry__ as entry  # noqa: E402
import verify  # noqa: E402


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in verify.TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return c


CORE = [n for n in entry._core.QUERIES]


@pytest.mark.parametrize("name", CORE)
def test_query(spark, sf, con, name):
    df = entry.queries()[name](spark, sf)
    rows = [r.asDict() for r in df.collect()]
    if name not in entry.oracle_sql():
        assert rows
        return
    rel = con.sql(entry.oracle_sql()[name])
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    want = [dict(zip(rel.columns, r)) for r in rel.fetchall()]
    assert verify.rows_of(rows, cols) == verify.rows_of(want, cols)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
