"""Every query with SQL equals DuckDB on the smallest tables, apart from the corpus operators, which have tests of their own."""

import duckdb
import pandas as pd
import pytest

from lectern.plans.catalogue import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, float):
        return int(v) if v == int(v) else round(v, 9)
    if hasattr(v, "tolist"):
        v = v.tolist()
    return tuple(plain(x) for x in v) if isinstance(v, (list, tuple)) else v


def rows(df):
    return sorted(repr(tuple(plain(x) for x in r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf, duck, name):
    got, want = QUERIES[name](spark, sf).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_other_queries_give_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).limit(5).count() > 0
