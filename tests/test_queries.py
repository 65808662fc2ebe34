"""Every registered query against its DuckDB oracle SQL (sf0.001):
same column names, same row multiset (doubles compared at 1e-9)."""

import datetime as dt
import decimal

import duckdb
import pytest

from entitygraph.plans.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    yield c
    c.close()


def _norm(v):
    if isinstance(v, float):
        return round(v, 9)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 9)
    return v


def test_every_query_has_oracle():
    assert set(ORACLE) <= set(QUERIES)
    missing = set(QUERIES) - set(ORACLE)
    assert missing == set(), missing


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF)
    rows = [tuple(_norm(x) for x in r) for r in df.collect()]
    rel = con.sql(ORACLE[name])
    assert sorted(df.columns) == sorted(rel.columns)
    idx = [rel.columns.index(c) for c in df.columns]
    want = [tuple(_norm(r[i]) for i in idx) for r in rel.fetchall()]
    assert len(rows) == len(want)
    assert sorted(map(repr, rows)) == sorted(map(repr, want))
