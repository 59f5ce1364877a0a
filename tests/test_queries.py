"""Every query with SQL against DuckDB on the smallest tables, and the driver's entry points."""

import datetime
import decimal

import duckdb
import pytest

import __spark_entry__ as entry
from heddle import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if x != x else round(x, 6) + 0.0
    if isinstance(x, decimal.Decimal):
        return round(float(x), 6) + 0.0
    if isinstance(x, datetime.datetime) and (x.hour, x.minute, x.second, x.microsecond) == (0, 0, 0, 0):
        return str(x.date())
    if isinstance(x, datetime.date):
        return str(x)
    return x


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([plain(r[i]) for i in order] for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, sf, duck, name):
    got = catalog.queries()[name](spark, sf)
    want = duck.sql(catalog.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql_runs(spark, sf, name):
    assert catalog.queries()[name](spark, sf).count() > 0


def test_entry_is_the_flagship_query(spark):
    assert entry.entry(spark).count() == 10
    assert set(catalog.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
