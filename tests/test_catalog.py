"""Queries against their SQL on the smallest tables."""

import datetime
import decimal

import duckdb
import pytest

from ticketloom.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float | decimal.Decimal):
        return round(float(value), 5) + 0.0
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    frame = catalog.QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    got = sorted(repr([plain(r[c]) for c in columns]) for r in frame.collect())
    if name not in catalog.ORACLE_SQL:
        assert frame.columns
        return
    cursor = duck.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = sorted(repr([plain(dict(zip(names, r, strict=True))[c]) for c in columns]) for r in cursor.fetchall())
    assert got == want
