"""Fitted classifiers and their evaluation: forests and sparse regressions of Spark's own library, a test part set aside, cross-validation and nested cross-validation.

A sample is a row with the vector of its features. Predictions come back as a long table, (id, part, fold, actual, predicted, probabilities): part is cross_validation or test, and probabilities are in the order of the classes. The tables of resample are made of it. Every fit asks policy first.

Models are fitted at once by a few threads of the driver, each a Spark job of its own. The frame is kept in memory or on disk meanwhile; it has a row a sample. A matrix of few samples has no such frame: its forests (matrix_predictions, matrix_importance) are grown over rows of features by wide_forest.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators import places, policy, wide_forest
from quillon.operators import resample as rs
from quillon.operators.matrix import profiles_of, sample_rows

#: Features of a vector; more are refused, as a sample's lie in one row.
FEATURES = 1_000_000
#: Fits that run at once.
THREADS = 8
#: Penalties of a path, from the least that lets no feature in to RATIO of it; steps of a fit.
PENALTIES, RATIO, STEPS = 8, 0.05, 30


def frame_of(p: DataFrame, samples: DataFrame) -> DataFrame:
    """(id, y, features): a row a sample that has a group, with its x by feature_id. p: a prepared matrix."""
    own = p.join(F.broadcast(samples.filter("grp is not null").select("sample", F.col("grp").alias("y"))), "sample")
    cells = F.array_sort(F.collect_list(F.struct("feature_id", "x")))
    rows = own.groupBy("sample", "y").agg(cells.alias("c"))
    rows = rows.withColumn("c", F.when(F.size("c") <= FEATURES, F.col("c")).otherwise(F.raise_error(F.lit(f"more than {FEATURES} features"))))
    return rows.select(F.col("sample").alias("id"), "y", array_to_vector(F.transform("c", lambda s: s["x"])).alias("features"))


def feature_places(p: DataFrame) -> DataFrame:
    """(feature_id, i): where each feature stands in the vectors, from 0."""
    return places.numbered(p.select("feature_id").distinct(), [], [F.col("feature_id")], "i").withColumn("i", F.col("i") - 1)


def classes_of(frame: DataFrame) -> list[str]:
    return [r.y for r in frame.select("y").distinct().orderBy("y").collect()]  # a row a class


def _labelled(frame: DataFrame, classes: list[str]) -> DataFrame:
    label = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("y")) - 1
    return frame.withColumn("label", label.cast("double").alias("label", metadata={"ml_attr": {"type": "nominal", "name": "label", "vals": classes}}))


@contextmanager
def _kept(frame: DataFrame):
    frame.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield
    finally:
        frame.unpersist()


def _at_once(jobs: list[Callable], session) -> list:
    with ThreadPool(min(THREADS, max(1, len(jobs)))) as pool:
        return pool.map(inheritable_thread_target(session)(lambda f: f()), jobs)


def forest(trees: int, seed: int) -> RandomForestClassifier:
    """Every tree grown until a node is pure, the square root of the features tried at each."""
    return RandomForestClassifier(numTrees=trees, seed=seed, featureSubsetStrategy="sqrt", maxDepth=30, minInstancesPerNode=1, maxMemoryInMB=512)


def _predicted(model, rows: DataFrame, part: str, fold, classes: list[str]) -> DataFrame:
    out = model.transform(rows).select("id", F.lit(part).alias("part"), F.lit(fold).cast("int").alias("fold"), F.col("y").alias("actual"), vector_to_array("probability").alias("probabilities"))
    return out.select("id", "part", "fold", "actual", rs.likeliest(F.col("probabilities"), classes).alias("predicted"), "probabilities")


def _evaluated(frame: DataFrame, classes: list[str], folds: int, holds_out: bool, share: float, seed: int, fit: Callable[[DataFrame, int], object]) -> DataFrame:
    """fit(rows, seed) gives a model. A model a fold, and one for the test part."""
    labels = frame.select("id", "y")
    dealt = _labelled(frame, classes).join(rs.folds(labels, folds, seed).select("id", "fold"), "id")
    if holds_out:
        dealt = dealt.join(rs.train_test(labels, share, seed, min_train=2).select("id", "part"), "id")
    with _kept(dealt):
        jobs = [lambda k=k: fit(dealt.filter(F.col("fold") != k), seed + k) for k in range(1, folds + 1)]
        if holds_out:
            jobs.append(lambda: fit(dealt.filter("part = 'train'"), seed))
        models = _at_once(jobs, frame.sparkSession)
    out = [_predicted(m, dealt.filter(F.col("fold") == k).drop("part"), "cross_validation", k, classes) for k, m in enumerate(models[:folds], 1)]
    if holds_out:
        out.append(_predicted(models[-1], dealt.filter("part = 'test'").drop("part"), "test", None, classes))
    every = out[0]
    for more in out[1:]:
        every = every.unionByName(more)
    return every


def forest_predictions(frame: DataFrame, trees: int = 500, seed: int = 123, mode: str = "auto", exploratory: bool = False, share: float = 0.7) -> DataFrame:
    """Out-of-fold predictions of forests, and those of the test part where there are samples enough for one."""
    d = policy.demanded(frame, "forest", mode=mode, exploratory=exploratory)
    return _evaluated(frame, classes_of(frame), d.folds, d.holds_out, share, seed, lambda rows, s: forest(trees, s).fit(rows))


def forest_importance(frame: DataFrame, names: DataFrame, trees: int = 500, seed: int = 123, exploratory: bool = False) -> DataFrame:
    """(feature_id, importance) of a forest of all samples, features that no tree uses left out. Importances sum to 1."""
    policy.demanded(frame, "forest", exploratory=exploratory)
    rows = _labelled(frame, classes_of(frame))
    with _kept(rows):
        v = forest(trees, seed).fit(rows).featureImportances
    used = frame.sparkSession.createDataFrame([(int(i), float(x)) for i, x in zip(v.indices, v.values, strict=True)], "i long, importance double")  # FEATURES at most
    return names.join(used, "i").select("feature_id", "importance")


def _bootstrapped(train: np.ndarray, trees: int, seed: int) -> np.ndarray:
    """(trees, samples): how often each sample is drawn from the trained ones, as many times as there are."""
    own, rng = np.flatnonzero(train), np.random.default_rng(seed)
    return np.array([np.bincount(own[rng.integers(0, len(own), len(own))], minlength=len(train)) for _ in range(trees)])


def _labels(samples: DataFrame) -> tuple[DataFrame, list[str], list[str], np.ndarray]:
    """((id, y) of the samples that have a group, their names in order, classes, the class of each)."""
    labels = samples.filter("grp is not null").select(F.col("sample").alias("id"), F.col("grp").alias("y"))
    rows = sorted(sample_rows(samples.filter("grp is not null")), key=lambda r: r.sample)
    classes = sorted({r.grp for r in rows})
    return labels, [r.sample for r in rows], classes, np.array([classes.index(r.grp) for r in rows])


def _profiles(p: DataFrame, samples: DataFrame, names: list[str]) -> DataFrame:
    """Profiles of the named samples of a prepared matrix: cells, or profiles of all samples."""
    if "v" not in p.columns:
        return profiles_of(p.filter(F.col("sample").isin(names)))
    at = [i for i, s in enumerate(sorted(r.sample for r in sample_rows(samples))) if s in set(names)]
    return p.select("feature_id", F.transform(F.array(*[F.lit(i) for i in at]), lambda i: F.get("v", i)).alias("v"))


def matrix_predictions(p: DataFrame, samples: DataFrame, trees: int = 500, seed: int = 123, mode: str = "auto", exploratory: bool = False, share: float = 0.7) -> DataFrame:
    """forest_predictions of a prepared matrix with any number of features. The forests of all folds grow together."""
    labels, names, classes, y = _labels(samples)
    d = policy.demanded(labels, "forest", mode=mode, exploratory=exploratory)
    fold = {r.id: r.fold for r in rs.folds(labels, d.folds, seed).collect()}  # a row a sample
    fold = np.array([fold[s] for s in names])
    fits = [("cross_validation", k, fold == k, seed + k) for k in range(1, d.folds + 1)]
    if d.holds_out:
        part = {r.id: r.part for r in rs.train_test(labels, share, seed, min_train=2).collect()}
        fits.append(("test", None, np.array([part[s] == "test" for s in names]), seed))
    g = wide_forest.grow(_profiles(p, samples, names), y, len(classes), np.concatenate([_bootstrapped(~held, trees, s) for *_, held, s in fits]), seed)
    out = []
    for i, (part, k, held, _) in enumerate(fits):
        shares = g.leaf[g.node[i * trees : (i + 1) * trees]].mean(0)
        out += [(names[j], part, k, classes[y[j]], shares[j].tolist()) for j in np.flatnonzero(held)]
    pred = p.sparkSession.createDataFrame(out, "id string, part string, fold int, actual string, probabilities array<double>")
    return pred.select("id", "part", "fold", "actual", rs.likeliest(F.col("probabilities"), classes).alias("predicted"), "probabilities")


def matrix_importance(p: DataFrame, samples: DataFrame, trees: int = 500, seed: int = 123, exploratory: bool = False) -> DataFrame:
    """forest_importance of a prepared matrix with any number of features: each tree's drops of impurity sum to 1, and so do their means."""
    labels, names, classes, y = _labels(samples)
    policy.demanded(labels, "forest", exploratory=exploratory)
    g = wide_forest.grow(_profiles(p, samples, names), y, len(classes), _bootstrapped(np.ones(len(names), bool), trees, seed), seed)
    of = p.sparkSession.createDataFrame(g.splits, "tree int, feature_id string, drop_ double")  # a row a split
    per = of.groupBy("tree", "feature_id").agg(F.sum("drop_").alias("d")).withColumn("d", F.col("d") / F.sum("d").over(rs.Window.partitionBy("tree")))
    total = len({t for t, *_ in g.splits})
    return per.groupBy("feature_id").agg((F.sum("d") / max(1, total)).alias("importance"))


def penalties(frame: DataFrame, n: int = PENALTIES, alpha: float = 1.0, ratio: float = RATIO) -> list[float]:
    """n penalties, falling by even factors from the least that lets no feature in. The scaled features' products with the classes are summed in one pass."""
    classes = classes_of(frame)
    share = {r.y: r.share for r in frame.groupBy("y").agg(F.count(F.lit(1)).alias("n")).select("y", (F.col("n") / F.sum("n").over(rs.Window.partitionBy())).alias("share")).collect()}
    cells = frame.select("y", F.posexplode(vector_to_array("features")).alias("i", "x"))
    pulls = [F.abs(F.avg(F.col("x") * ((F.col("y") == c).cast("double") - share[c]))).alias(f"p{k}") for k, c in enumerate(classes)]
    per = cells.groupBy("i").agg(F.stddev_pop("x").alias("s"), *pulls).filter("s > 0")
    most = per.agg(F.max(F.greatest(*[F.col(f"p{k}") for k in range(len(classes))], F.lit(0.0)) / F.col("s"))).first()[0] or 0.0
    high = max(most, 1e-6) / max(alpha, 1e-3)
    return [high * ratio ** (k / max(1, n - 1)) for k in range(n)]


def regression(penalty: float, alpha: float, classes: int) -> LogisticRegression:
    return LogisticRegression(regParam=penalty, elasticNetParam=alpha, family="binomial" if classes == 2 else "multinomial", standardization=True, maxIter=STEPS, tol=1e-4)


def one_standard_error(errors: list[float], spread: list[float], folds: int, rule: str = "1se") -> int:
    """The place of the penalty to take, largest penalty first: of the least mean error, or the first within a standard error of it."""
    best = min(range(len(errors)), key=lambda i: (errors[i], i))
    if rule == "min":
        return best
    return next(i for i, e in enumerate(errors) if e <= errors[best] + spread[best] / folds**0.5)


def sparse(rows: DataFrame, classes: list[str], path: list[float], folds: int, alpha: float, rule: str, seed: int):
    """(model, penalty): regressions along the path in each fold, the penalty by the rule, and the model of all rows with it. rows: (id, y, label, features)."""
    dealt = rows.drop("fold").join(rs.folds(rows.select("id", "y"), folds, seed).select("id", (F.col("fold") - 1).cast("int").alias("inner_fold")), "id").coalesce(1 if rows.count() < 1000 else folds)
    est = regression(path[0], alpha, len(classes))
    cv = CrossValidator(estimator=est, estimatorParamMaps=[{est.regParam: x} for x in path], evaluator=MulticlassClassificationEvaluator(metricName="accuracy"), numFolds=folds, foldCol="inner_fold", parallelism=THREADS)
    with _kept(dealt):
        fitted = cv.fit(dealt)
        chosen = path[one_standard_error([1 - a for a in fitted.avgMetrics], list(fitted.stdMetrics), folds, rule)]
        return regression(chosen, alpha, len(classes)).fit(dealt), chosen


def sparse_coefficients(frame: DataFrame, names: DataFrame, alpha: float = 1.0, n: int = PENALTIES, rule: str = "1se", seed: int = 123, exploratory: bool = False, folds: object = "Auto") -> DataFrame:
    """(feature_id, class, coefficient) that aren't 0, of the regression of all samples. With two classes they are the second's."""
    d = policy.demanded(frame, "sparse", exploratory=exploratory, folds=folds)
    classes = classes_of(frame)
    model, _ = sparse(_labelled(frame, classes), classes, penalties(frame, n, alpha), d.folds, alpha, rule, seed)
    m = model.coefficientMatrix.toArray()
    of = classes[1:] if len(classes) == 2 else classes
    found = [(int(i), of[k], float(m[k, i])) for k, i in zip(*m.nonzero(), strict=True)]  # FEATURES times classes at most
    coefficients = frame.sparkSession.createDataFrame(found, "i long, class string, coefficient double")
    return names.join(coefficients, "i").select("feature_id", "class", "coefficient")


def sparse_predictions(frame: DataFrame, alpha: float = 1.0, n: int = PENALTIES, rule: str = "1se", seed: int = 123, mode: str = "auto", exploratory: bool = False, folds: object = "Auto", share: float = 0.7) -> DataFrame:
    """Nested cross-validation: each outer fold's model takes its penalty from folds of its own training rows."""
    d = policy.demanded(frame, "sparse", mode=mode, exploratory=exploratory, folds=folds)
    classes, path = classes_of(frame), penalties(frame, n, alpha)

    def fit(rows: DataFrame, s: int):
        inner = policy.demanded(rows, "sparse_inner", folds=folds).folds
        return sparse(rows, classes, path, inner, alpha, rule, s)[0]

    return _evaluated(frame, classes, d.folds, d.holds_out, share, seed, fit)


def class_columns(pred: DataFrame, classes: list[str]) -> DataFrame:
    """Predictions as they are written out: Sample, Fold, Actual, Predicted and a column for each class."""
    return pred.select(F.col("id").alias("Sample"), F.col("fold").alias("Fold"), F.col("actual").alias("Actual"), F.col("predicted").alias("Predicted"), *[F.col("probabilities")[i].alias(c) for i, c in enumerate(classes)])


def evaluation(pred: DataFrame, classes: list[str]) -> dict[str, DataFrame]:
    """The tables of one part's predictions as they are written out: confusion_matrix, class_metrics, summary_metrics and, with two classes, roc_curve."""
    held = F.col("actual")
    cells = rs.confusion(pred).groupBy(held.alias("Actual")).agg(*[F.coalesce(F.sum(F.when(F.col("predicted") == c, F.col("n"))), F.lit(0)).alias(c) for c in classes])
    per = rs.class_metrics(pred).select(F.col("class").alias("Class"), *[F.col(c).alias(c.upper()) for c in ("tp", "fp", "tn", "fn")], F.col("sensitivity").alias("Sensitivity"), F.col("specificity").alias("Specificity"), F.col("precision").alias("Precision"), F.col("f1").alias("F1"))
    total = rs.summary(pred)
    out = {"confusion_matrix": cells, "class_metrics": per}
    area = F.lit(None).cast("double").alias("auc")
    if len(classes) == 2:
        scored = pred.withColumn("score", F.col("probabilities")[1])
        total = total.join(F.broadcast(rs.auc(scored, classes[1])))
        out["roc_curve"] = rs.roc(scored, classes[1]).select((1 - F.col("fpr")).alias("Specificity"), F.col("tpr").alias("Sensitivity"), F.col("threshold").alias("Threshold"), F.lit(classes[1]).alias("PositiveClass"))
    else:
        total = total.withColumn("auc", area)
    names = {"accuracy": "Accuracy", "macro_sensitivity": "Macro sensitivity", "macro_specificity": "Macro specificity", "macro_f1": "Macro F1", "auc": "AUC"}
    out["summary_metrics"] = total.unpivot([], list(names), "k", "Value").select(F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.col("k")).alias("Metric"), "Value")
    return out
