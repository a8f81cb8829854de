"""Every finance query against its DuckDB oracle on the smallest tables."""

from __future__ import annotations

import decimal
import math
import os

import duckdb
import pytest

from ledgerlake.operators import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return f"D{v}" if isinstance(v, decimal.Decimal) else str(v)


def rows(records):
    return sorted(tuple(norm(x) for x in r) for r in records)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf, name):
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = rows(df.select(*cols).collect())
    if name not in ORACLE_SQL:
        return
    want = duck.sql(ORACLE_SQL[name])
    assert cols == sorted(want.columns)
    assert got == rows(want.project(", ".join(f'"{c}"' for c in cols)).fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE_SQL) <= set(entry.oracle_sql())
    assert entry.entry(spark).count() > 0
