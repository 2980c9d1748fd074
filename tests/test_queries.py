"""Every registered query with SQL against DuckDB, at the smallest scale."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

from lexmill.plans import registry

SF = "/root/testdata/sf0.001"
NAMES = sorted(registry.oracle_sql())


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def norm(v):
    return repr(round(v, 6)) if isinstance(v, float) else repr(v)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    r = duck.sql(registry.oracle_sql()[name])
    names = r.columns
    want = sorted(tuple(norm(dict(zip(names, x, strict=True))[c]) for c in cols) for x in r.fetchall())
    assert sorted(names) == cols and got == want


def test_queries_without_sql_run(spark):
    for name in sorted(registry.queries().keys() - registry.oracle_sql().keys()):
        assert registry.queries()[name](spark, SF).count() > 0, name
