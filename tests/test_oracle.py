"""Every registered sales and text query against its DuckDB SQL on the smallest tables."""

import datetime
import decimal

import duckdb
import pytest

from ledgerlight.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in names) for r in df.collect()]
    if name not in registry.ORACLE_SQL:
        assert got
        return
    found = duck.sql(registry.ORACLE_SQL[name])
    assert sorted(found.columns) == names
    at = [found.columns.index(c) for c in names]
    want = [tuple(plain(r[i]) for i in at) for r in found.fetchall()]
    key = lambda row: tuple((v is None, str(v)) for v in row)
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        for x, y in zip(a, b):  # the engines round ties of doubles differently
            assert x == y or isinstance(x, float) and y is not None and abs(x - y) < 0.0101
