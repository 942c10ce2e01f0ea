"""The long matrix (feature_id, sample, grp, value): dense cells, filtering, imputation, scores.

A matrix has few samples and many features. What works on whole features takes profiles, a row a feature. Every step on cells keeps a feature's cells in one partition, so one shuffle on feature_id serves them all.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Samples that a matrix may have; more are refused, as they are listed in plans.
MAX_SAMPLES = 10_000


def feature() -> WindowSpec:
    """All cells of a feature."""
    return Window.partitionBy("feature_id")


def sample_rows(samples: DataFrame) -> list:
    rows = samples.orderBy("sample_ord", "sample").limit(MAX_SAMPLES + 1).collect()
    if len(rows) > MAX_SAMPLES:
        raise ValueError(f"a matrix of more than {MAX_SAMPLES} samples")
    return rows


def dense(q: DataFrame, samples: DataFrame) -> DataFrame:
    """A row for each feature and sample; cells that q lacks, and NaN, are null."""
    value = F.when(~F.isnan("value"), F.col("value"))
    cells = q.groupBy("feature_id").agg(F.map_from_entries(F.collect_list(F.struct("sample", value.alias("value")))).alias("cells"))
    rows = sample_rows(samples)
    if not rows:
        return q.select("feature_id", "sample", "grp", "value").limit(0)
    every = F.array(*[F.struct(F.lit(r.sample).alias("sample"), F.lit(r.grp).alias("grp")) for r in rows])
    return cells.select("feature_id", "cells", F.explode(every).alias("s")).select("feature_id", "s.sample", "s.grp", F.try_element_at("cells", F.col("s.sample")).alias("value"))


def log2_1p(value: Column) -> Column:
    """log2(x + 1); null at or below -1."""
    return F.when(value > -1, F.log2(value + 1))


def filtered(d: DataFrame, min_valid: float, log: bool = True) -> DataFrame:
    """(…, x): features with at least max(1, ceil(samples * min_valid)) values, not imputed."""
    x = log2_1p(F.col("value")) if log else F.col("value")
    d = d.withColumn("x", x)
    need = F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)).over(feature()) * F.lit(min_valid)))
    return d.withColumn("keep_", F.count("x").over(feature()) >= need).filter("keep_").drop("keep_")


def prepared(d: DataFrame, min_valid: float, log: bool = True) -> DataFrame:
    """filtered, missing cells filled with the feature's median."""
    return filtered(d, min_valid, log).withColumn("x", F.coalesce("x", F.median("x").over(feature())))


def profiles(q: DataFrame, samples: DataFrame, min_valid: float, log: bool = True) -> DataFrame:
    """(feature_id, v): prepared(dense(q, samples)) with a row a feature, its x in order of sample. One shuffle and no window."""
    names = sorted(r.sample for r in sample_rows(samples))
    if not names:
        return q.select("feature_id", F.array().cast("array<double>").alias("v")).limit(0)
    value = F.when(~F.isnan("value"), F.col("value"))
    cells = q.groupBy("feature_id").agg(F.map_from_entries(F.collect_list(F.struct("sample", value.alias("value")))).alias("cells"))
    x = F.transform(F.array(*[F.lit(n) for n in names]), lambda n: F.try_element_at(F.col("cells"), n))
    rows = cells.select("feature_id", (F.transform(x, log2_1p) if log else x).alias("v"))
    rows = rows.withColumn("have", F.array_sort(F.filter("v", lambda c: c.isNotNull()))).filter(F.size("have") >= max(1, math.ceil(len(names) * min_valid)))
    median = (F.get("have", F.expr("(size(have) - 1) div 2")) + F.get("have", F.expr("size(have) div 2"))) / 2
    return rows.withColumn("median", median).select("feature_id", F.transform("v", lambda c: F.coalesce(c, F.col("median"))).alias("v"))


def profiles_of(p: DataFrame) -> DataFrame:
    """A prepared matrix with a row a feature: p as profiles gives it, or its cells gathered."""
    return p.select("feature_id", "v") if "v" in p.columns else vectors(p)


def top_profiles(p: DataFrame, n: int, names: list[str]) -> DataFrame:
    """(feature_id, sample, x): top_variance of profiles, whose samples are names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = np.asarray(b.column(1).flatten()).reshape(b.num_rows, -1)
                var = np.where(x.max(1) > x.min(1), x.var(1, ddof=1), 0.0) if x.shape[1] > 1 else np.full(len(x), np.nan)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(var, from_pandas=True)], ["feature_id", "v", "variance"])

    var = p.select("feature_id", "v").mapInArrow(run, "feature_id string, v array<double>, variance double").filter("variance is not null")
    best = var.orderBy(F.desc(F.round("variance", 9)), "feature_id").limit(n)
    own = F.array(*[F.lit(s) for s in names])
    return best.select("feature_id", F.explode(F.arrays_zip(own.alias("sample"), F.col("v").alias("x"))).alias("c")).select("feature_id", "c.*")


def top_variance(p: DataFrame, n: int) -> DataFrame:
    """Cells of the n features whose x varies most (ties by feature_id)."""
    var = p.groupBy("feature_id").agg(F.round(F.var_samp("x"), 9).alias("variance")).filter("variance is not null")
    best = var.orderBy(F.desc("variance"), "feature_id").limit(n)
    return p.join(best, "feature_id")


def z_scores(p: DataFrame) -> DataFrame:
    """(…, z): x centred and scaled in its feature; 0 where it doesn't vary."""
    z = F.try_divide(F.col("x") - F.avg("x").over(feature()), F.stddev_samp("x").over(feature()))
    return p.withColumn("z", F.coalesce(z, F.lit(0.0)))


def wide(q: DataFrame, names: list[str], column: str = "value") -> DataFrame:
    """feature_id and a column for each sample."""
    return q.groupBy("feature_id").pivot("sample", names).agg(F.first(column))


def vectors(p: DataFrame, column: str = "x") -> DataFrame:
    """(feature_id, v): a feature's cells in order of sample."""
    cells = F.array_sort(F.collect_list(F.struct("sample", F.col(column).alias("c"))))
    return p.groupBy("feature_id").agg(F.transform(cells, lambda s: s["c"]).alias("v"))
