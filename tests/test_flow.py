"""Flow queries against SQL of another engine, on the smallest tables."""

from __future__ import annotations

import datetime as dt

import duckdb
import pytest

from odweave.plans.queries import oracle_sql, queries

TABLES = "region nation customer supplier part orders lineitem".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(x):
    if isinstance(x, dt.datetime):
        return x.date()
    return x


def rows(names, data):
    return sorted(repr(tuple(plain(r[n]) for n in names)) for r in data)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, sf_dir, duck, name):
    df = queries()[name](spark, sf_dir)
    want = duck.execute(oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(names, (r.asDict() for r in df.collect())) == rows(names, (dict(zip(names, r, strict=True)) for r in want.fetchall()))
