"""Fitted classifiers on planted samples."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import fitted as ft
from quillon.operators import policy as po
from quillon.operators import resample as rs
from quillon.operators import select as sl


def planted(spark, n=36, features=30, classes=3, seed=1):
    """Two features tell each class from the others."""
    rng = np.random.default_rng(seed)
    y = np.arange(n) % classes
    x = rng.normal(0, 1, (n, features))
    for k in range(classes):
        x[y == k, 2 * k : 2 * k + 2] += 5
    samples = spark.createDataFrame([(f"S{i:02d}", f"c{y[i]}", i, int(y[i])) for i in range(n)] + [("none", None, 99, 9)], "sample string, grp string, sample_ord int, group_ord int")
    cells = [(f"P{j:03d}", f"S{i:02d}", f"c{y[i]}", float(x[i, j])) for i in range(n) for j in range(features)] + [(f"P{j:03d}", "none", None, 0.0) for j in range(features)]
    return spark.createDataFrame(cells, "feature_id string, sample string, grp string, x double"), samples


@pytest.fixture(scope="module")
def three(spark):
    p, s = planted(spark)
    return p, s, ft.frame_of(p, s)


def test_frame_has_a_row_a_labelled_sample(three):
    p, _, frame = three
    rows = frame.collect()
    assert len(rows) == 36 and {r.y for r in rows} == {"c0", "c1", "c2"}
    names = {r.i: r.feature_id for r in ft.feature_places(p).collect()}
    one = {r.feature_id: r.x for r in p.filter("sample = 'S05'").collect()}
    assert {names[i]: v for i, v in enumerate(next(r for r in rows if r.id == "S05").features)} == one


def test_forest_predictions(three):
    _, _, frame = three
    pred = ft.forest_predictions(frame, trees=50).persist()
    assert pred.columns == ["id", "part", "fold", "actual", "predicted", "probabilities"]
    cv = pred.filter("part = 'cross_validation'")
    assert sorted(r.id for r in cv.collect()) == [f"S{i:02d}" for i in range(36)] and {r.fold for r in cv.collect()} == {1, 2, 3, 4, 5}
    held = pred.filter("part = 'test'").collect()
    assert len(held) == 9 and all(r.fold is None and abs(sum(r.probabilities) - 1) < 1e-9 for r in held)
    assert rs.balanced_accuracy(pred, "part").agg(F.min("balanced_accuracy")).first()[0] > 0.9
    shown = ft.class_columns(cv, ["c0", "c1", "c2"])
    assert shown.columns == ["Sample", "Fold", "Actual", "Predicted", "c0", "c1", "c2"]
    tables = ft.evaluation(cv, ["c0", "c1", "c2"])
    assert set(tables) == {"confusion_matrix", "class_metrics", "summary_metrics"}
    assert tables["confusion_matrix"].columns == ["Actual", "c0", "c1", "c2"] and tables["class_metrics"].count() == 3
    summary = {r.Metric: r.Value for r in tables["summary_metrics"].collect()}
    assert summary["Accuracy"] > 0.9 and summary["AUC"] is None and len(summary) == 5


def test_forest_importance_finds_what_was_planted(three):
    p, _, frame = three
    table = ft.forest_importance(frame, ft.feature_places(p), trees=50)
    assert {r.feature_id for r in sl.by_importance(table, "importance", 6).collect()} == {f"P{j:03d}" for j in range(6)}
    ranks = sl.by_importance(table, "importance").collect()
    assert sorted(r["rank"] for r in ranks) == list(range(1, len(ranks) + 1))


def test_two_classes_have_a_roc_curve(spark):
    p, s = planted(spark, 24, 10, 2)
    pred = ft.forest_predictions(ft.frame_of(p, s), trees=20)
    tables = ft.evaluation(pred.filter("part = 'cross_validation'"), ["c0", "c1"])
    assert tables["roc_curve"].columns == ["Specificity", "Sensitivity", "Threshold", "PositiveClass"]
    assert {r.Metric: r.Value for r in tables["summary_metrics"].collect()}["AUC"] > 0.9


def test_sparse_regression(spark):
    p, s = planted(spark, 40, 12, 2)
    frame = ft.frame_of(p, s)
    c = ft.sparse_coefficients(frame, ft.feature_places(p), rule="min").collect()
    assert c and {r["class"] for r in c} == {"c1"} and {r.feature_id for r in c} <= {f"P{j:03d}" for j in range(12)} and all(r.coefficient for r in c)
    assert {r.feature_id for r in sorted(c, key=lambda r: -abs(r.coefficient))[:2]} <= {f"P{j:03d}" for j in range(4)}
    sums = {r.feature_id: (r.total, r.classes) for r in sl.coefficient_sums(spark.createDataFrame(c)).collect()}
    assert sums == {r.feature_id: (abs(r.coefficient), 1) for r in c}
    pred = ft.sparse_predictions(frame, n=4).persist()
    assert pred.filter("part = 'cross_validation'").count() == 40 and pred.filter("part = 'test'").count() == 12
    assert rs.balanced_accuracy(pred, "part").agg(F.min("balanced_accuracy")).first()[0] > 0.9


def test_penalties_start_where_nothing_enters(spark):
    p, s = planted(spark, 30, 8, 3)
    frame = ft.frame_of(p, s)
    path = ft.penalties(frame, 5)
    assert path == sorted(path, reverse=True) and len(path) == 5
    rows = ft._labelled(frame, ["c0", "c1", "c2"])
    assert ft.regression(path[0] * 1.01, 1.0, 3).fit(rows).coefficientMatrix.toArray().any() == False  # noqa: E712
    assert ft.regression(path[1], 1.0, 3).fit(rows).coefficientMatrix.toArray().any()


def test_standard_error_rule():
    assert ft.one_standard_error([0.5, 0.3, 0.25, 0.2, 0.22], [0.1] * 5, 4) == 2
    assert ft.one_standard_error([0.5, 0.3, 0.25, 0.2, 0.22], [0.1] * 5, 4, "min") == 3
    assert ft.one_standard_error([0.2, 0.2], [0.0, 0.0], 4) == 0


def test_too_few_samples_are_refused(spark):
    p, s = planted(spark, 12, 6, 3)
    frame = ft.frame_of(p, s)
    for f in (lambda: ft.forest_predictions(frame), lambda: ft.sparse_predictions(frame, exploratory=True), lambda: ft.sparse_coefficients(frame, ft.feature_places(p), exploratory=True)):
        with pytest.raises(po.PolicyError):
            f()
    assert ft.forest_predictions(frame, trees=5, exploratory=True).count() == 12
