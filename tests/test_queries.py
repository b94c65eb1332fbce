"""Each query with SQL against DuckDB over the same tables."""

import math
import os

import duckdb
import pytest

from lacuna import queries

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return "null" if v is None else str(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no sample tables")
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_as_sql(spark, con, name):
    df = queries.QUERIES[name](spark, DATA)
    rel = con.sql(queries.SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(rel.columns, rel.fetchall())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no sample tables")
@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, DATA).count() > 0
