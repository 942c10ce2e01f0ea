"""Places, running totals and medians by slices give what whole windows give."""

import random
from statistics import median

import pytest
from pyspark.sql import functions as F

from quillon.operators import places

SCHEMA = "k string, v double, id string, x long"


def rows(n=600, seed=3):
    rng = random.Random(seed)
    out = [("hot", rng.choice([0.0, 0.0, 1.5, rng.random(), None]), f"i{i:05d}", rng.randrange(1 << 40)) for i in range(n)]
    return out + [(rng.choice(["a", "b", None]), rng.random(), f"j{i:05d}", rng.randrange(9)) for i in range(60)] + [("one", 2.0, "z", 1)]


def order(r):
    return (r[1] is not None, r[1] or 0.0, r[2])


@pytest.mark.parametrize("slices", [1, 3, 64])
def test_numbered(spark, slices):
    data = rows()
    got = places.numbered(spark.createDataFrame(data, SCHEMA).repartition(5), ["k"], [F.col("v"), F.col("id")], slices=slices)
    assert got.columns == ["k", "v", "id", "x", "place"]
    want = {}
    for k in {r[0] for r in data}:
        want |= {r[2]: i for i, r in enumerate(sorted((r for r in data if r[0] == k), key=order), 1)}
    assert {r.id: r.place for r in got.collect()} == want


def test_numbered_without_keys_and_with_known_slices(spark):
    data = rows(100)
    df = spark.createDataFrame(data, SCHEMA)
    want = {r[2]: i for i, r in enumerate(sorted(data, key=order), 1)}
    assert {r.id: r.place for r in places.numbered(df, [], [F.col("v"), F.col("id")]).collect()} == want
    got = places.numbered(df.filter("k = 'hot'"), ["k"], [F.col("id")], slice_=F.substring("id", 4, 2).cast("int"))
    some = sorted(r[2] for r in data if r[0] == "hot")
    assert {r.id: r.place for r in got.collect() if r.k == "hot"} == {i: n for n, i in enumerate(some, 1)}


@pytest.mark.parametrize("how", ["sum", "xor", "min"])
@pytest.mark.parametrize("back", [False, True])
def test_running(spark, how, back):
    data = rows()
    got = places.running(spark.createDataFrame(data, SCHEMA).repartition(3), ["k"], [F.col("v"), F.col("id")], {"y": F.col("x"), "z": F.col("x") + 1}, how, back, slices=7)
    f = {"sum": lambda a, b: a + b, "xor": lambda a, b: a ^ b, "min": min}[how]
    want = {}
    for k in {r[0] for r in data}:
        y = z = None
        for r in sorted((r for r in data if r[0] == k), key=order, reverse=back):
            y, z = (r[3], r[3] + 1) if y is None else (f(y, r[3]), f(z, r[3] + 1))
            want[r[2]] = (y, z)
    assert {r.id: (r.y, r.z) for r in got.collect()} == want


@pytest.mark.parametrize("seed", [1, 2])
def test_medians(spark, seed):
    data = rows(seed=seed) + [("signs", v, "s", 0) for v in (-3.0, -2.5, 0.0, 1e-9, 4e9, -1e-12)] + [("even", float(v), "e", 0) for v in range(10)]
    got = places.medians(spark.createDataFrame(data, SCHEMA).repartition(5), ["k"], "v").collect()
    want = {k: median(r[1] for r in data if r[0] == k and r[1] is not None) for k in {r[0] for r in data}}
    assert {r.k: r["median"] for r in got} == want


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert places.numbered(df, ["k"], [F.col("v")]).count() == 0
    assert places.medians(df, ["k"], "v").count() == 0


def test_one_key_of_a_million_rows_is_dealt_evenly(spark):
    df = spark.range(1_000_000).select(F.lit("k").alias("k"), (F.col("id") % 2 * F.rand(1)).alias("v"), F.col("id").cast("string").alias("id"))  # half of all values are 0
    s, _ = places.sliced(df, ["k"], [F.col("v"), F.col("id")])
    sizes = [r["count"] for r in s.groupBy("slice_").count().collect()]
    assert sum(sizes) == 1_000_000 and max(sizes) < 50_000
    got = places.numbered(df, ["k"], [F.col("v"), F.col("id")]).agg(F.max("place").alias("m"), F.count_distinct("place").alias("n")).first()
    assert (got.m, got.n) == (1_000_000, 1_000_000)
