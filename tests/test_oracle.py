"""Every query of the reference's operators against its SQL twin, on the smallest tables."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb
import pytest

from tidemark import registry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    return c


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, bool):
        return x
    if isinstance(x, int | float | decimal.Decimal):
        return float(x)
    if isinstance(x, datetime.date | datetime.datetime):
        return x.isoformat()
    return x


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = registry.queries()[name](spark, DIR)
    want = duck.sql(registry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    at = [want.columns.index(c) for c in df.columns]
    key = lambda r: tuple(map(str, r))
    got = sorted((tuple(map(plain, r)) for r in df.collect()), key=key)
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=key)
