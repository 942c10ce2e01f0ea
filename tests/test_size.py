"""What keeps queries in proportion to their tables: what a plan reads, and how often."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import text
from quillon.operators import matrix as mx
from quillon.operators import reduce as rd
from quillon.plans import registry

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def scans(df, table: str) -> int:
    return sum("FileScan" in line and f"/{table}.parquet" in line for line in plan(df).splitlines())


def test_summaries_count_rows_not_cells(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    try:
        df = registry.QUERIES["import_summaries"](spark, SF)
        assert scans(df, "lineitem") == 6  # a table each
        assert "Expand" not in plan(df)
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")


def test_accessions_are_parsed_in_a_row_a_part(spark):
    lines = plan(registry.QUERIES["proteins_diann"](spark, SF)).splitlines()
    parts = next(i for i, line in enumerate(lines) if "HashAggregate" in line)
    assert any("regexp_extract" in line for line in lines[:parts]) and not any("regexp_extract" in line or "format_string" in line for line in lines[parts:])


def test_unique_ids_read_their_rows_once(spark):
    keys = ["a", "a", "a", "a.1", "a.3", "a.1", "b", "", "", ".5", "c.01", "c", "c", "d.1000000000", "d", "d", None, None, "e\n.1", "e\n", "e\n"]
    df = spark.createDataFrame(list(enumerate(keys)), "i int, k string")
    out = text.unique_ids(df, "k", ["i"], "u")
    assert {r.i: r.u for r in out.collect()} == dict(enumerate(
        ["a", "a.2", "a.4", "a.1", "a.3", "a.1.1", "b", "", ".1", ".5", "c.01", "c", "c.1", "d.1000000000", "d", "d.1", None, None, "e\n.1", "e\n", "e\n.1"]))
    again = plan(text.unique_ids(df, "k", ["i"], "u"))
    assert "Join" not in again and again.count("Exchange hashpartitioning") == 1


def test_accession_in_one_pattern(spark):
    cells = {"sp|Q1|N_X d;tr|Q2|M": "Q1", "tr|A|": "A", "sp||X": "sp", "sp|": "sp", "P1|x": "P1", "P1;P2": "P1", " P3 ; x": "P3", "|x": "", "spA|B": "spA", "NA": None, "": None, None: None, ";x": None, "sp|A": "A", "NaN;P": None}
    df = spark.createDataFrame([(k,) for k in cells], "c string")
    got = {r.c: r.a for r in df.select("c", text.clean_accession(df.c).alias("a")).collect()}
    assert got == cells


def matrix(spark):
    """30 features of 9 samples with gaps, equal values and features that don't vary or hold too little."""
    rng = np.random.default_rng(5)
    samples = spark.createDataFrame([(f"S{i}", f"G{i % 3}", i, i % 3) for i in range(9)], "sample string, grp string, sample_ord int, group_ord int")
    x = np.round(rng.lognormal(3, 1, (30, 9)), 0)
    x[rng.random(x.shape) < 0.25] = np.nan
    x[0], x[1], x[2, 1:], x[3, 0] = 9.1, np.nan, np.nan, -3
    cells = [(f"P{j:02d}", f"S{i}", f"G{i % 3}", float(x[j, i])) for j in range(30) for i in range(9) if (i + j) % 7 or j < 4]
    return spark.createDataFrame(cells, "feature_id string, sample string, grp string, value double"), samples


def test_profiles_are_the_prepared_cells(spark):
    q, s = matrix(spark)
    for share in (0.0, 0.5, 0.9):
        want = {r.feature_id: r.v for r in mx.vectors(mx.prepared(mx.dense(q, s), share)).collect()}
        assert {r.feature_id: r.v for r in mx.profiles(q, s, share).collect()} == want
    assert mx.profiles(q, s.limit(0), 0.5).count() == 0


def test_profiles_give_what_cells_give(spark):
    q, s = matrix(spark)
    cells, rows = mx.prepared(mx.dense(q, s), 0.5), mx.profiles(q, s, 0.5)
    order = s.filter("sample <> 'S4'").select("sample", F.pmod(F.col("sample_ord") * 5, F.lit(7)).cast("double").alias("t"))
    for o in (order, order.filter("sample_ord < 6"), order.limit(2)):
        want = {r.feature_id: (round(r.rho, 9), round(r.p, 9), r.ties) for r in rd.rank_correlation(cells, o).collect()}
        assert {r.feature_id: (round(r.rho, 9), round(r.p, 9), r.ties) for r in rd.profile_correlation(rows, s, o).collect()} == want
    names = [f"S{i}" for i in range(9)]
    want = {(r.feature_id, r.sample): r.x for r in mx.top_variance(cells, 7).collect()}
    assert {(r.feature_id, r.sample): r.x for r in mx.top_profiles(rows, 7, names).collect()} == want
    a, b = ({(r.sample1, r.sample2): r["product"] for r in rd.inner_products(p, s).collect()} for p in (cells, rows))
    assert a == pytest.approx(b)
    z = [{(r.feature_id, r.sample): round(r.z, 9) for r in rd.heatmap(p, s, 7)[0].collect()} for p in (cells, rows)]
    assert z[0] == z[1]


def test_a_feature_that_does_not_vary_along_the_order_has_no_correlation(spark):
    samples = spark.createDataFrame([(f"S{i}", "G", i, 0) for i in range(5)], "sample string, grp string, sample_ord int, group_ord int")
    cells = spark.createDataFrame([("A", f"S{i}", 2.0) for i in range(5)] + [("B", f"S{i}", float(i)) for i in range(5)], "feature_id string, sample string, x double")
    order = samples.select("sample", F.col("sample_ord").cast("double").alias("t"))
    for got in (rd.rank_correlation(cells, order), rd.profile_correlation(mx.vectors(cells), samples, order)):
        assert [(r.feature_id, round(r.rho, 9)) for r in got.collect()] == [("B", 1.0)]


def test_an_order_without_q_reads_the_lines_once(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    try:
        df = registry.QUERIES["order_spearman_exact"](spark, SF.replace("0.001", "0.01"))
        assert scans(df, "lineitem") == 1 and "Window" not in plan(df)
        for name in ("heatmap_kmeans_columns", "pseudotime_spearman"):  # their last tables hold what was computed
            assert scans(registry.QUERIES[name](spark, SF.replace("0.001", "0.01")), "lineitem") == 0
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
