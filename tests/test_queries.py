"""Every registered query of the library runs on the smallest tables and agrees with its SQL."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from medialake.bindings import TABLES
from medialake.plans.registry import ORACLE, QUERIES


@pytest.fixture(scope="session")
def duck(sf_small):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_small}/{name}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, int | float) or type(v).__name__ == "Decimal":
        return float(f"{float(v):.9g}")
    return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(plain(r[i]) for i in order) for r in data], key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf_small, name):
    got = QUERIES[name](spark, sf_small)
    want = duck.sql(ORACLE[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 21
    assert set(entry.oracle_sql()) <= set(entry.queries())
