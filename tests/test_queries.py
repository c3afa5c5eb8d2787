"""Every query with SQL against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest
from headwater import catalog, catalog_control, catalog_streams  # noqa: F401  the others add to the first

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def rows(df):
    df = df[sorted(df.columns)]
    plain = lambda x: round(float(x), 5) if isinstance(x, float) else x
    return sorted((tuple(None if x != x else plain(x) for x in r) for r in df.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), duck.sql(catalog.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_all_queries_have_sql():
    assert set(catalog.QUERIES) - set(catalog.ORACLE_SQL) == {"stream_templates"}  # a replay: see test_streams.py
    assert set(catalog.ORACLE_SQL) <= set(catalog.QUERIES)
