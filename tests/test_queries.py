"""Every query outside llm against its SQL, on the smallest tables."""

import datetime
import decimal

import duckdb
import pytest

import __spark_entry__ as entry
from depscope.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages labels conversations".split()


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float | decimal.Decimal):
        return f"{float(value):.6g}"
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return repr(value)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, tables, name):
    found = catalog.queries()[name](spark, DATA)
    want = tables.sql(catalog.oracle_sql()[name])
    assert sorted(found.columns) == sorted(want.columns)
    order = [want.columns.index(c) for c in found.columns]
    mine = sorted(tuple(map(plain, r)) for r in found.collect())
    assert mine == sorted(tuple(plain(r[k]) for k in order) for r in want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
