"""Every query with a SQL twin gives the same rows as DuckDB on the smallest tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

from terraloom.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}") + 0.0
    if isinstance(v, list):
        return tuple(map(plain, v))
    return v


def rows(arrow):
    names = sorted(arrow.column_names)
    return names, sorted((tuple(map(plain, r)) for r in zip(*(arrow.column(n).to_pylist() for n in names), strict=True)), key=repr)


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_same_rows(spark, duck, name):
    got = rows(catalogue.QUERIES[name](spark, DATA).toArrow())
    want = rows(duck.sql(catalogue.ORACLE[name]).to_arrow_table())
    assert got[1], "no rows"
    assert got == want
