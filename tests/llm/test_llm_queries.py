"""The queries with SQL against DuckDB, on whole tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

from lexmill.llm import queries

SF = os.environ.get("LLM_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, name):
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df = queries.queries()[name](spark, SF)
    want = c.sql(queries.oracle_sql()[name])
    assert sorted(want.columns) == sorted(df.columns)
    assert sorted(tuple(r[k] for k in want.columns) for r in df.collect()) == sorted(want.fetchall())
