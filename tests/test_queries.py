"""Each registered query that has SQL, against DuckDB on the smallest tables."""

import datetime
import decimal
import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return ("number", round(float(v), 6))
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_rows_as_sql(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    found = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted((tuple(plain(row[names.index(c)]) for c in sorted(names)) for row in found.fetchall()), key=repr)
    got = sorted((tuple(plain(row[c]) for c in sorted(names)) for row in df.collect()), key=repr)
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() == 1


def test_every_library_query_has_sql():
    from chunkwright.plans import catalogue

    assert catalogue.queries().keys() == catalogue.oracle_sql().keys()
