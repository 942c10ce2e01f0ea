"""Every query with SQL gives DuckDB's rows; the others give rows of the right shape."""

import math
import os

import duckdb
import pytest

from quillon.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    return v


@pytest.mark.parametrize("name", [k for k in registry.QUERIES if k in registry.SQL])
def test_same_rows(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    got = duck.execute(registry.SQL[name])
    names = [c[0] for c in got.description]
    assert sorted(names) == sorted(df.columns)
    cols = sorted(df.columns)
    a = sorted(([plain(r[c]) for c in cols] for r in df.collect()), key=repr)
    b = sorted(([plain(r[names.index(c)]) for c in cols] for r in got.fetchall()), key=repr)
    assert a == b


@pytest.mark.parametrize("name", ["pca_scores", "volcano_moderated", "pseudotime_spearman", "combined_score", "tsne_coordinates", "umap_coordinates"])
def test_rows_only(spark, name):
    rows = registry.QUERIES[name](spark, "/root/testdata/sf0.01").collect()
    assert rows
    for r in rows:
        assert all(not isinstance(v, float) or math.isfinite(v) for v in r)
