"""Every query with oracle SQL against DuckDB, on the smallest tables."""

import math

import duckdb
import pytest

from touchline.plans import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    return round(v, 5) if isinstance(v, float) and math.isfinite(v) else v


def rows(cols, got):
    order = sorted(range(len(cols)), key=lambda k: cols[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in got), key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    exp = duck.sql(queries.ORACLES[name])
    assert sorted(df.columns) == sorted(exp.columns)
    got = rows(df.columns, df.collect())
    want = rows(exp.columns, exp.fetchall())
    assert len(got) == len(want)
    assert got == want


def test_no_query_is_without_rows(spark):
    empty = [n for n in sorted(queries.QUERIES) if queries.QUERIES[n](spark, SF.replace("0.001", "0.01")).isEmpty()]
    assert empty == []
