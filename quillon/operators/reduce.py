"""Samples in two dimensions, their clusters and their order along a trajectory.

What grows is the number of features: inner products of samples are summed over features in one distributed pass. What is left is a matrix of samples by samples, whose size matrix.sample_rows has checked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from quillon.functions import kernels
from quillon.functions.stats import rank_correlation_p
from quillon.operators import policy
from quillon.operators.differential import adjusted
from quillon.operators.matrix import profiles_of, sample_rows, top_profiles, top_variance, vectors, z_scores
from quillon.operators.written import once


#: Features that coordinates need at least.
VARYING = 2


def gram(vec: DataFrame, standardised: bool = False) -> tuple[np.ndarray, int]:
    """(sums over rows of v v^T, rows): a partial sum a task, then row by row of the result. standardised: of the rows that vary, each centred and scaled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = None, 0
        for b in batches:
            if b.num_rows:
                x = np.asarray(b.column(0).flatten()).reshape(b.num_rows, -1)
                if standardised:
                    x = x[x.max(1) > x.min(1)] if x.shape[1] else x[:0]
                    x = (x - x.mean(1, keepdims=True)) / x.std(1, ddof=1, keepdims=True) if len(x) else x
                total, n = x.T @ x if total is None else total + x.T @ x, n + len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(total)), pa.int32()), pa.array([[float(n)], *total], pa.list_(pa.float64()))], ["i", "g"])

    parts = vec.select("v").mapInArrow(run, "i int, g array<double>").select("i", array_to_vector("g").alias("g"))
    rows = parts.groupBy("i").agg(Summarizer.sum(F.col("g")).alias("g")).orderBy("i").collect()  # a row a sample
    if not rows:
        return np.zeros((0, 0)), 0
    return np.array([r.g.toArray() for r in rows[1:]]), int(rows[0].g[0])


def sample_space(p: DataFrame, samples: DataFrame) -> tuple[list, np.ndarray]:
    """(samples by name, inner products of their standardised, centred profiles); features that don't vary drop out."""
    rows, g, n = _space(p, samples)
    if n < VARYING:
        raise ValueError(f"{VARYING} features that vary are needed")
    return rows, g


def _space(p: DataFrame, samples: DataFrame) -> tuple[list, np.ndarray, int]:
    """sample_space, and how many features vary."""
    rows = sorted(sample_rows(samples), key=lambda r: r.sample)
    return rows, *gram(profiles_of(p), standardised=True)


def inner_products(p: DataFrame, samples: DataFrame) -> DataFrame:
    """(sample1, sample2, product) of sample_space."""
    rows, g = sample_space(p, samples)
    data = [(r.sample, g[i].tolist()) for i, r in enumerate(rows)]
    lines = p.sparkSession.createDataFrame(data, "sample1 string, g array<double>").select("sample1", F.posexplode("g").alias("i", "product"))
    names = F.array(*[F.lit(r.sample) for r in rows])
    return lines.select("sample1", F.get(names, F.col("i")).alias("sample2"), "product")


def _frame(p: DataFrame, rows: list, cols: dict[str, np.ndarray]) -> DataFrame:
    data = [(r.sample, r.grp, *(round(float(c[i]), 6) for c in cols.values())) for i, r in enumerate(rows)]
    return p.sparkSession.createDataFrame(data, "sample string, grp string, " + ", ".join(f"{k} double" for k in cols))


def _squares(g: np.ndarray) -> np.ndarray:
    return np.maximum(np.diag(g)[:, None] + np.diag(g)[None] - 2 * g, 0)


def pca(p: DataFrame, samples: DataFrame) -> DataFrame:
    rows, g = sample_space(p, samples)
    s, _ = kernels.components_of(g)
    return _frame(p, rows, {"pc1": s[:, 0], "pc2": s[:, 1]})


def pca_variance(p: DataFrame, samples: DataFrame) -> DataFrame:
    _, g = sample_space(p, samples)
    share = kernels.components_of(g)[1]
    return p.sparkSession.createDataFrame([(i + 1, round(float(v) * 100, 6)) for i, v in enumerate(share)], "component int, percent double")


def tsne(p: DataFrame, samples: DataFrame, perplexity: float | None = None, steps: int = 1000) -> DataFrame:
    rows, g = sample_space(p, samples)
    if len(rows) < 4:
        raise ValueError("t-SNE needs four samples")
    y = kernels.tsne(_squares(g), kernels.components_of(g)[0], kernels.perplexity_for(len(rows), perplexity), steps)
    return _frame(p, rows, {"tsne1": y[:, 0], "tsne2": y[:, 1]})


def umap(p: DataFrame, samples: DataFrame, neighbours: int = 10, min_dist: float = 0.1) -> DataFrame:
    rows, g = sample_space(p, samples)
    y = kernels.neighbour_layout(np.sqrt(_squares(g)), kernels.components_of(g)[0], neighbours, min_dist)
    return _frame(p, rows, {"umap1": y[:, 0], "umap2": y[:, 1]})


def sample_clusters(p: DataFrame, samples: DataFrame, k: int = 4, method: str = "complete") -> DataFrame:
    """Samples by agglomeration of the distances of their profiles: cluster and place in the tree."""
    rows, g = sample_space(p, samples)
    order, label = kernels.linkage_order(np.sqrt(_squares(g)), k, method)
    place = {s: i + 1 for i, s in enumerate(order)}
    return p.sparkSession.createDataFrame([(r.sample, r.grp, label[i], place[i]) for i, r in enumerate(rows)], "sample string, grp string, cluster int, place int")


def correlation_clusters(corr: DataFrame, k: int = 4) -> DataFrame:
    """Samples by average linkage of 1 - r."""
    rows = corr.collect()  # samples by samples
    names = sorted({r.sample1 for r in rows})
    at = {n: i for i, n in enumerate(names)}
    d = np.zeros((len(names), len(names)))
    for r in rows:
        d[at[r.sample1], at[r.sample2]] = max(0.0, 1 - r.correlation)
    order, label = kernels.linkage_order(d, k, "average")
    place = {s: i + 1 for i, s in enumerate(order)}
    return corr.sparkSession.createDataFrame([(n, label[i], place[i]) for i, n in enumerate(names)], "sample string, cluster int, place int")


def _clusters(rows: DataFrame, key: str, k: int, seed: int) -> DataFrame:
    """(key, cluster) of rows (key, v) by Spark's K-means, clusters from 1 in the order of their first row's key."""
    from pyspark.ml.clustering import KMeans

    v = rows.select(key, array_to_vector("v").alias("features"))
    got = KMeans(k=k, seed=seed).fit(v).transform(v).select(key, F.col("prediction").alias("p_"))
    first = got.groupBy("p_").agg(F.min(key).alias("first_"))
    order = first.select("p_", F.row_number().over(Window.orderBy("first_")).alias("cluster"))  # a row a cluster
    return got.join(F.broadcast(order), "p_").select(key, "cluster")


def feature_kmeans(p: DataFrame, k: int = 4, seed: int = 123) -> DataFrame:
    """(feature_id, cluster) of features by their z-scores."""
    return _clusters(vectors(z_scores(p), "z"), "feature_id", k, seed)


def heatmap(p: DataFrame, samples: DataFrame, top: int = 100, rows: str = "none", columns: str = "none", row_k: int = 4, column_k: int = 4, seed: int = 123) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The z-scores of the features that vary most, and the order of both sides: (row_order, feature_id, sample, z), (row_order, feature_id, kmeans_cluster), (col_order, sample, grp, kmeans_cluster). rows and columns are none or kmeans. Sides are ordered by cluster, then as in the source: features by feature_id, samples by sample_ord. top features at most lie in one row."""
    if {rows, columns} - {"none", "kmeans"}:
        raise ValueError("rows and columns are none or kmeans")
    if "v" in p.columns:
        p = top_profiles(p, top, sorted(r.sample for r in sample_rows(samples)))
    else:
        p = top_variance(p, top)
    z = once(z_scores(p).select("feature_id", "sample", "z"), "heatmap")  # read by every step of the clustering
    size = z.agg(F.count_distinct("feature_id").alias("features"), F.count_distinct("sample").alias("samples")).first()
    if size.features < VARYING or size.samples < 2:
        raise ValueError("a heatmap needs two features and two samples")
    none = F.lit(None).cast("int")
    features = z.select("feature_id").distinct()
    side = features.join(_clusters(vectors(z, "z"), "feature_id", policy.clusters(row_k, size.features), seed), "feature_id") if rows == "kmeans" else features.withColumn("cluster", none)
    place = F.row_number().over(Window.orderBy("cluster", "feature_id"))  # of top features
    row_order = side.select(place.alias("row_order"), "feature_id", F.col("cluster").alias("kmeans_cluster"))
    own = samples.select("sample", "grp", "sample_ord")
    if columns == "kmeans":
        v = z.groupBy("sample").agg(F.transform(F.array_sort(F.collect_list(F.struct("feature_id", "z"))), lambda c: c["z"]).alias("v"))
        own = own.join(_clusters(v, "sample", policy.clusters(column_k, size.samples), seed), "sample")
    else:
        own = own.withColumn("cluster", none)
    at = F.row_number().over(Window.orderBy("cluster", "sample_ord", "sample"))  # of the samples
    col_order = own.select(at.alias("col_order"), "sample", "grp", F.col("cluster").alias("kmeans_cluster"))
    values = z.join(F.broadcast(row_order.select("row_order", "feature_id")), "feature_id").select("row_order", "feature_id", "sample", "z")
    return values, row_order, col_order


def pseudotime(p: DataFrame, samples: DataFrame, start: str, end: str | None = None) -> DataFrame:
    """(sample, grp, lineage, pseudotime): groups are the clusters; lineages run from the start group along the tree of their centres, with end only those that end there. policy refuses what a trajectory can't use."""
    rows, g, n = _space(p, samples)
    few = n < policy.TRAJECTORY["proteins"]  # those that don't vary count as well
    policy.trajectory(rows, p.select("feature_id").distinct().count() if few else n, start, end)
    if n < VARYING:
        raise ValueError(f"{VARYING} features that vary are needed")
    names = sorted({r.grp for r in rows})
    y = kernels.components_of(g)[0]
    of = np.array([names.index(r.grp) for r in rows])
    centres = np.stack([y[of == i].mean(0) for i in range(len(names))])
    out = []
    paths = [x for x in kernels.lineages(centres, names.index(start)) if end is None or names[x[-1]] == end]
    for k, path in enumerate(paths, 1):
        own = np.flatnonzero(np.isin(of, path))
        t = kernels.along(y[own], centres[path]) if len(path) > 1 else np.zeros(len(own))
        out += [(rows[i].sample, rows[i].grp, k, round(float(v), 6)) for i, v in zip(own, t, strict=True)]
    return p.sparkSession.createDataFrame(out, "sample string, grp string, lineage int, pseudotime double")


def rank_correlation(p: DataFrame, order: DataFrame) -> DataFrame:
    """(feature_id, rho, p, ties, q) of each feature's x with order (sample, t): correlation of average ranks. p is exact for few values without ties, by the Edgeworth series for more, by t with ties."""
    def average_rank(column: str, by) -> F.Column:
        same = Window.partitionBy(*by, column)
        return (F.rank().over(Window.partitionBy(*by).orderBy(column)) + (F.count(F.lit(1)).over(same) - 1) / 2).cast("double")

    cells = p.select("feature_id", "sample", F.round("x", 9).alias("x")).join(F.broadcast(order.select("sample", "t")), "sample")
    ranked = cells.withColumn("rx", average_rank("x", ["feature_id"])).withColumn("rt", average_rank("t", ["feature_id"]))
    rho = F.try_divide(F.covar_pop("rx", "rt"), F.stddev_pop("rx") * F.stddev_pop("rt"))  # corr fails where ranks don't vary
    r = ranked.groupBy("feature_id").agg(rho.alias("rho"), F.count(F.lit(1)).alias("n"), F.count_distinct("x").alias("u"), F.count_distinct("t").alias("v")).withColumn("ties", (F.col("u") < F.col("n")) | (F.col("v") < F.col("n"))).filter("u > 2 and v > 2 and n > 2 and rho is not null and not isnan(rho)")
    r = r.withColumn("p", _rank_p("rho", "n", "ties"))
    return adjusted(once(r.select("feature_id", "rho", "p", "ties"), "rank_correlation"))


def profile_correlation(p: DataFrame, samples: DataFrame, order: DataFrame) -> DataFrame:
    """(feature_id, rho, p, ties): rank_correlation, not adjusted, of profiles of these samples. A row a feature, no shuffle."""
    names = sorted(r.sample for r in sample_rows(samples))
    t = {r.sample: r.t for r in order.select("sample", "t").collect() if r.sample in names}  # a row a sample
    at, t = [i for i, s in enumerate(names) if s in t], np.array([t[s] for s in names if s in t], float)
    schema = "feature_id string, rho double, p double, ties boolean"
    if len(at) < 3 or len(np.unique(t)) < 3:
        return p.sparkSession.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rt = _average_ranks(t[None])
        for b in batches:
            if not b.num_rows:
                continue
            x = np.asarray(b.column(1).flatten()).reshape(b.num_rows, -1)
            same = np.diff(np.sort(x, 1), axis=1) == 0
            some = len(at) - same.sum(1) > 2
            rx, same = _average_ranks(x[some]), same[some]
            cx, ct = rx - rx.mean(1, keepdims=True), rt - rt.mean()
            rho = (cx * ct).sum(1) / np.sqrt((cx**2).sum(1) * (ct**2).sum())
            ties = same.any(1) | (len(np.unique(t)) < len(at))
            p_ = rank_correlation_p(rho, np.full(len(rho), len(at)), ties)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(some)), pa.array(rho), pa.array(p_), pa.array(ties)], ["feature_id", "rho", "p", "ties"])

    own = F.transform(F.array(*[F.lit(i) for i in at]), lambda i: F.round(F.get("v", i), 9))
    return p.select("feature_id", own.alias("v")).mapInArrow(run, schema)


def _average_ranks(x: np.ndarray) -> np.ndarray:
    """Ranks within each row, equal values' their mean."""
    order = np.argsort(x, 1, kind="stable")
    v = np.take_along_axis(x, order, 1)
    place, new = np.arange(x.shape[1]), np.ones(v.shape, bool)
    new[:, 1:] = v[:, 1:] != v[:, :-1]
    first = np.maximum.accumulate(np.where(new, place, 0), 1)
    end = np.concatenate([new[:, 1:], np.ones((len(x), 1), bool)], 1)
    last = np.minimum.accumulate(np.where(end, place, x.shape[1])[:, ::-1], 1)[:, ::-1]
    out = np.empty(x.shape)
    np.put_along_axis(out, order, (first + last) / 2 + 1, 1)
    return out


@F.pandas_udf(DoubleType())
def _rank_p(rho: pd.Series, n: pd.Series, ties: pd.Series) -> pd.Series:
    return pd.Series(rank_correlation_p(rho.to_numpy(float), n.to_numpy(), ties.to_numpy(bool)))


def by_association(table: DataFrame, n: int | None = None) -> DataFrame:
    """rank_correlation's rows by q, then by strength; the n best, or all."""
    out = table.orderBy(F.asc_nulls_last("q"), F.desc(F.abs("rho")), "feature_id")
    return out if n is None else out.filter("q is not null").orderBy("q", F.desc(F.abs("rho")), "feature_id").limit(n)


def in_pseudotime(order: DataFrame) -> DataFrame:
    """(lineage, place, sample, pseudotime) of pseudotime's rows."""
    place = F.row_number().over(Window.partitionBy("lineage").orderBy("pseudotime", "sample"))
    return order.filter("pseudotime is not null").select("lineage", place.alias("place"), "sample", "pseudotime")


def with_pseudotime(coordinates: DataFrame, order: DataFrame) -> DataFrame:
    """Coordinates of samples with their pseudotimes, null where they are on no lineage."""
    return coordinates.join(F.broadcast(order.select("sample", "lineage", "pseudotime")), "sample", "left")


def lineage_paths(order: DataFrame) -> DataFrame:
    """(lineage, path): each lineage's groups in the order of their mean pseudotime."""
    means = order.groupBy("lineage", "grp").agg(F.avg("pseudotime").alias("t"))
    return means.groupBy("lineage").agg(F.array_sort(F.collect_list(F.struct("t", "grp"))).alias("g")).select("lineage", F.array_join(F.transform("g", lambda x: x["grp"]), " -> ").alias("path"))
