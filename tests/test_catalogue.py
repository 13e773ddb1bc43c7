"""Every query of the library against DuckDB on the smallest tables."""

import os

import pytest

from marginalia.plans.queries import ORACLE_SQL, QUERIES
from tests.conftest import SMALL

TABLES = "documents embeddings pages benchmark labels conversations events".split()


def plain(v):
    return round(v, 5) if isinstance(v, float) else v.isoformat()[:23] if hasattr(v, "isoformat") else v


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no sample tables")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_like_duckdb(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    want = duck.sql(ORACLE_SQL[name])
    assert sorted(want.columns) == columns
    order = [want.columns.index(c) for c in columns]
    expected = sorted((tuple(plain(r[i]) for i in order) for r in want.fetchall()), key=str)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str) == expected


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_rows(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_entry_without_corpus_operators(spark, small):
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
