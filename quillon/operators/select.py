"""Selection of features by repeated resampling: random forests, sparse regression and both together.

Each repeat takes its own training samples, the features that vary most among them and the medians to fill in. The features are scanned once for all repeats; a repeat's regression and each block of its trees are tasks of their own over at most top_var features.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import kernels
from quillon.operators import policy
from quillon.operators.matrix import sample_rows, vectors, z_scores
from quillon.operators.resample import split_plan

#: Parts that a repeat's features are first ranked in.
PARTS = 32
#: Trees of a block.
BLOCK = 50
WEIGHTS = {"top20": 0.35, "top50": 0.25, "l1": 0.30, "gini": 0.10}


def plan_of(samples: DataFrame, repeats: int, share: float, seed: int, exploratory: bool = False) -> tuple[list[str], np.ndarray, list[str], np.ndarray]:
    """(samples by name, class of each, classes, repeats by samples: trained on), if policy lets forests and regressions be fitted."""
    labels = samples.select(F.col("grp").alias("y"))
    for analysis in ("forest", "sparse"):
        policy.demanded(labels, analysis, exploratory=exploratory)
    rows = sorted(sample_rows(samples), key=lambda r: r.sample)
    classes = sorted({r.grp for r in rows})
    names = [r.sample for r in rows]
    train = np.zeros((repeats, len(rows)), bool)
    at = {n: i for i, n in enumerate(names)}
    for r in split_plan(samples.select(F.col("sample").alias("id"), F.col("grp").alias("y")), repeats, share, seed).filter("part = 'train'").collect():
        train[r.repeat - 1, at[r.id]] = True
    return names, np.array([classes.index(r.grp) for r in rows]), classes, train


def candidates(filtered: DataFrame, train: np.ndarray, top_var: int) -> DataFrame:
    """(repeat, feature_id, v): the top_var features of each repeat by variance among its training samples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            v = np.asarray(b.column(1).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)).reshape(b.num_rows, -1)
            rep, row, var = [], [], []
            for i, t in enumerate(train):
                x = v[:, t]
                n = (~np.isnan(x)).sum(1)
                mean = np.nansum(x, 1) / np.maximum(n, 1)
                s = np.where(n > 1, np.nansum((x - mean[:, None]) ** 2, 1) / np.maximum(n - 1, 1), -np.inf)
                best = np.argsort(-s, kind="stable")[:top_var]  # no more than these can be among all
                best = best[np.isfinite(s[best])]
                rep += [i + 1] * len(best)
                row += best.tolist()
                var += np.round(s[best], 9).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(rep, pa.int32()), b.column(0).take(pa.array(row, pa.int64())), b.column(1).take(pa.array(row, pa.int64())), pa.array(var)], ["repeat", "feature_id", "v", "var"])

    rows = vectors(filtered).mapInArrow(run, "repeat int, feature_id string, v array<double>, var double")
    place = F.row_number().over(Window.partitionBy("repeat").orderBy(F.desc("var"), "feature_id"))
    return rows.withColumn("n", place).filter(F.col("n") <= top_var).select("repeat", "feature_id", "v")


def fits(filtered: DataFrame, samples: DataFrame, repeats: int = 50, share: float = 0.8, top_var: int = 200, trees: int = 500, seed: int = 123, folds: object = "Auto", exploratory: bool = False) -> DataFrame:
    """(repeat, feature_id, gini, gini_rank, l1, forest_accuracy, l1_accuracy) of every candidate. The penalty is chosen by five folds, or as many as asked, or as the smallest class has training samples; fewer than four are refused. Samples without a group take no part."""
    samples = samples.filter("grp is not null")
    filtered = filtered.join(F.broadcast(samples.select("sample")), "sample", "left_semi")
    _, y, classes, train = plan_of(samples, repeats, share, seed, exploratory)
    k = policy.inner_folds(int(min(np.bincount(y[t], minlength=len(classes)).min() for t in train)), folds)
    blocks = -(-trees // BLOCK)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Block 0 is the regression, the others are trees."""
        r, block = int(pdf["repeat"].iloc[0]), int(pdf["block"].iloc[0])
        pdf = pdf.sort_values("feature_id").reset_index(drop=True)
        x = np.array([np.asarray(v, float) for v in pdf["v"]]).T
        tr = train[r - 1]
        fill = np.nanmedian(x[tr], 0)
        x = np.where(np.isnan(x), fill, x)
        gini, l1 = np.zeros(x.shape[1]), np.zeros(x.shape[1])
        if block:
            own = min(BLOCK, trees - (block - 1) * BLOCK)
            forest, gini = kernels.forest(x[tr], y[tr], len(classes), own, [seed + r, block])
            gini = gini * own
            votes = kernels.forest_predict(forest, x[~tr], len(classes)) * own
        else:
            scale = x[tr].std(0)
            z = (x - x[tr].mean(0)) / np.where(scale > 0, scale, 1)
            fold = np.zeros(len(y), int)
            for c in range(len(classes)):
                own = np.flatnonzero((y == c) & tr)
                fold[own] = np.arange(len(own)) % k
            w, b = kernels.elastic_net(z[tr], y[tr], len(classes), kernels.chosen_lambda(z[tr], y[tr], len(classes), fold[tr]))
            l1, votes = np.abs(w).sum(1), z[~tr] @ w + b
        return pd.DataFrame({"repeat": r, "block": block, "feature_id": pdf["feature_id"], "gini": gini, "l1": l1, "votes": [votes.ravel() if i == 0 else None for i in range(len(pdf))]})

    def together(pdf: pd.DataFrame) -> pd.DataFrame:
        r = int(pdf["repeat"].iloc[0])
        pdf = pdf.sort_values(["block", "feature_id"])
        per = pdf.groupby("feature_id", as_index=False)[["gini", "l1"]].sum()
        gini = per["gini"].to_numpy() / trees
        test = y[~train[r - 1]]
        votes = pdf[pdf["votes"].notna()]

        def accuracy(some: pd.DataFrame) -> float:
            total = sum(np.asarray(v, float) for v in some["votes"])
            return (total.reshape(-1, len(classes)).argmax(1) == test).mean() if len(test) else np.nan

        rank = np.lexsort((per["feature_id"].to_numpy(str), -gini)).argsort() + 1
        return pd.DataFrame({"repeat": r, "feature_id": per["feature_id"], "gini": gini, "gini_rank": rank, "l1": per["l1"], "forest_accuracy": accuracy(votes[votes["block"] > 0]), "l1_accuracy": accuracy(votes[votes["block"] == 0])})

    tasks = candidates(filtered, train, top_var).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks))))
    tasks = tasks.repartition(int(filtered.sparkSession.conf.get("spark.sql.shuffle.partitions")), "repeat", "block")  # few bytes, much work: not to be coalesced
    parts = tasks.groupBy("repeat", "block").applyInPandas(run, "repeat int, block int, feature_id string, gini double, l1 double, votes array<double>")
    schema = "repeat int, feature_id string, gini double, gini_rank long, l1 double, forest_accuracy double, l1_accuracy double"
    return parts.groupBy("repeat").applyInPandas(together, schema)


def stability(f: DataFrame, universe: DataFrame, repeats: int, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """Frequencies, scaled Gini and the weighted score of every feature of the universe; what a repeat left out counts 0."""
    per = f.groupBy("feature_id").agg(
        (F.count_if(F.col("gini_rank") <= 20) / repeats).alias("top20_frequency"), (F.count_if(F.col("gini_rank") <= 50) / repeats).alias("top50_frequency"),
        (F.sum("gini") / repeats).alias("mean_gini"), (F.count_if(F.col("l1") > 0) / repeats).alias("l1_frequency"),
    )
    all_ = universe.select("feature_id").distinct().join(per, "feature_id", "left").na.fill(0.0)
    bounds = all_.agg(F.min("mean_gini").alias("low_"), F.max("mean_gini").alias("high_"))
    scaled = F.coalesce(F.try_divide(F.col("mean_gini") - F.col("low_"), F.col("high_") - F.col("low_")), F.lit(0.0))
    out = all_.join(F.broadcast(bounds)).withColumn("gini_scaled", scaled).drop("low_", "high_")
    w = weights
    forest = w["top20"] * F.col("top20_frequency") + w["top50"] * F.col("top50_frequency") + w["gini"] * F.col("gini_scaled")
    return out.withColumn("forest_score", forest).withColumn("combined_score", forest + w["l1"] * F.col("l1_frequency"))


def ranked(s: DataFrame, score: str, n: int = 50) -> DataFrame:
    """(rank, feature_id, score) of the n best that any component selects."""
    some = s.filter("top20_frequency > 0 or top50_frequency > 0 or l1_frequency > 0 or mean_gini > 0")
    best = some.orderBy(F.desc(F.round(score, 9)), F.desc("top20_frequency"), F.desc("top50_frequency"), F.desc(F.round("mean_gini", 9)), "feature_id").limit(n)
    place = F.row_number().over(Window.orderBy(F.desc(F.round(score, 9)), F.desc("top20_frequency"), F.desc("top50_frequency"), F.desc(F.round("mean_gini", 9)), "feature_id"))  # of n rows
    return best.select(place.alias("rank"), "feature_id", F.round(score, 6).alias("score"))


def union_of(lists: list[tuple[str, DataFrame]], n: int = 50) -> DataFrame:
    """(feature_id, source): lists in order, each feature where it comes first."""
    return placed_union(lists, n).drop("place")


def placed_union(lists: list[tuple[str, DataFrame]], n: int = 50) -> DataFrame:
    """union_of with each feature's place."""
    if not lists:
        raise ValueError("no selected features")
    every = None
    for i, (name, df) in enumerate(lists):
        own = df.select("feature_id", "rank", F.lit(i).alias("i"), F.lit(name).alias("source"))
        every = own if every is None else every.unionByName(own)
    return _first_places(every, n)


def _first_places(every: DataFrame, n: int) -> DataFrame:
    """(feature_id, source, place): the n features that come first in the lists, each where it comes first."""
    first = every.groupBy("feature_id").agg(F.min(F.struct("i", "rank", "source")).alias("m"))
    best = first.orderBy("m.i", "m.rank", "feature_id").limit(n)
    place = F.row_number().over(Window.orderBy("m.i", "m.rank", "feature_id"))  # of n rows
    return best.select("feature_id", F.col("m.source").alias("source"), place.alias("place"))


def training_plan(samples: DataFrame, repeats: int, share: float = 0.8, seed: int = 123) -> DataFrame:
    """(repeat, sample) of the samples that a repeat trains on."""
    plan = split_plan(samples.select(F.col("sample").alias("id"), F.col("grp").alias("y")), repeats, share, seed)
    return plan.filter("part = 'train'").select("repeat", F.col("id").alias("sample"))


def top_in_training(filtered: DataFrame, plan: DataFrame, n: int) -> DataFrame:
    """(repeat, feature_id, variance, fill): the n features that vary most among a repeat's training samples, and their medians there. Features are ranked in parts first, so no task holds them all."""
    cells = filtered.join(F.broadcast(plan), "sample")
    own = cells.groupBy("repeat", "feature_id").agg(F.round(F.var_samp("x"), 9).alias("variance"), F.round(F.median("x"), 6).alias("fill")).filter("variance is not null")
    order = [F.desc("variance"), F.asc("feature_id")]
    own = own.withColumn("part_", F.pmod(F.hash("feature_id"), F.lit(PARTS)))
    for keys in (["repeat", "part_"], ["repeat"]):
        own = own.withColumn("n_", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("n_") <= n)
    return own.select("repeat", "feature_id", "variance", "fill")


def with_source(summary: DataFrame, forest: DataFrame, regression: DataFrame) -> DataFrame:
    """summary with the importance and coefficient of its features and what selected them: RF, L1 or both."""
    out = summary.join(forest.select("feature_id", "importance"), "feature_id", "left").join(regression.select("feature_id", "coefficient"), "feature_id", "left")
    f, r = F.col("importance").isNotNull(), F.col("coefficient").isNotNull()
    return out.withColumn("source", F.when(f & r, "RF+L1").when(f, "RF").when(r, "L1"))


def coefficient_sums(coefficients: DataFrame) -> DataFrame:
    """(feature_id, total, classes) of (class, feature_id, coefficient): sums of sizes, and the classes where it isn't 0."""
    return coefficients.groupBy("feature_id").agg(F.sum(F.abs("coefficient")).alias("total"), F.count_if(F.col("coefficient") != 0).alias("classes")).filter("classes > 0")


def by_importance(table: DataFrame, column: str, n: int | None = None) -> DataFrame:
    """The n rows, or all, of the largest column first, ties by feature_id, with their rank from 1."""
    from quillon.operators import places

    if n is None:
        return places.numbered(table, [], [-F.round(column, 9), F.col("feature_id")], "rank")
    best = table.orderBy(F.desc(F.round(column, 9)), "feature_id").limit(n)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.round(column, 9)), "feature_id")).cast("long"))  # of n rows


def selected(p: DataFrame, lists: list[tuple[str, DataFrame]], n: int = 50) -> DataFrame:
    """The cells of a prepared matrix of the features that lists select (placed_union), with place and source; two features at least must be there."""
    chosen = placed_union(lists, n)
    out = p.join(F.broadcast(chosen), "feature_id")  # n rows
    if out.select("feature_id").distinct().limit(2).count() < 2:
        raise ValueError("two selected features are needed in the matrix")
    return out


def selected_scores(p: DataFrame, lists: list[tuple[str, DataFrame]], n: int = 50) -> DataFrame:
    """selected with z, the cells' scores, as a heatmap of the selected features shows them."""
    return z_scores(selected(p, lists, n))
