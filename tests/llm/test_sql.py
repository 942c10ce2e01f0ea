"""Queries with SQL give DuckDB's rows."""

import duckdb
import pytest

from quillon.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(registry.SQL))
def test_same_rows(spark, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    df = registry.QUERIES[name](spark, SF)
    got = con.execute(registry.SQL[name])
    names = [c[0] for c in got.description]
    cols = sorted(df.columns)
    assert sorted(names) == cols
    assert sorted(tuple(r[c] for c in cols) for r in df.collect()) == sorted(tuple(r[names.index(c)] for c in cols) for r in got.fetchall())
