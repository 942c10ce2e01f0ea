"""Forests over rows of features, against plain counting and on planted samples."""

import numpy as np
import pytest
from test_fitted import planted

from quillon.operators import fitted as ft
from quillon.operators import matrix as mx
from quillon.operators import policy as po
from quillon.operators import resample as rs
from quillon.operators import wide_forest as wf
from quillon.plans import registry


def test_a_node_tries_as_many_features_as_asked():
    sizes = np.array([5, 0, 9, 1, 3, 3, 0, 7])
    want = np.array([3, 28, 0, 11])
    each = np.array([wf.tried(sizes, b, want, [1, 2]) for b in range(8)])
    assert (each.sum(0) == want).all() and (each <= sizes[:, None]).all() and (each >= 0).all()
    node, place = wf.drawn(np.array([3, 0, 7, 1]), 7, np.random.default_rng(1))
    assert np.bincount(node, minlength=4).tolist() == [3, 0, 7, 1] and len(set(zip(node, place))) == 11 and set(place) <= set(range(7))
    often = np.bincount(np.concatenate([wf.drawn(np.array([3]), 9, np.random.default_rng(s))[1] for s in range(3000)]))
    assert (abs(often - 1000) < 120).all()


def test_splits_are_the_best_there_are():
    rng = np.random.default_rng(3)
    y = rng.integers(0, 3, 12)
    x, w = np.round(rng.normal(0, 1, (200, 12)), 1), rng.integers(0, 3, (200, 12)).astype(float)
    drop, _ = wf.splits(x, np.argsort(x, 1, kind="stable"), y, 3, w)

    def gini(own):
        return 1 - sum((own[y == c].sum() / own.sum()) ** 2 for c in range(3))

    for v, own, got in zip(x, w, drop):
        best = -1
        for cut in np.unique(v)[:-1]:
            a, b = own * (v <= cut), own * (v > cut)
            if a.sum() and b.sum():
                best = max(best, gini(own) - (a.sum() * gini(a) + b.sum() * gini(b)) / own.sum())
        assert got == pytest.approx(best)


@pytest.fixture(scope="module")
def three(spark):
    return planted(spark)


def test_predictions(three):
    p, s = three
    pred = ft.matrix_predictions(p, s, trees=50).persist()
    assert pred.columns == ["id", "part", "fold", "actual", "predicted", "probabilities"]
    rows = pred.collect()
    assert sorted(r.id for r in rows if r.part == "cross_validation") == [f"S{i:02d}" for i in range(36)] and {r.fold for r in rows} == {1, 2, 3, 4, 5, None}
    assert sum(r.part == "test" for r in rows) == 9 and all(abs(sum(r.probabilities) - 1) < 1e-9 for r in rows)
    assert all(r.balanced_accuracy > 0.9 for r in rs.balanced_accuracy(pred, "part").collect())
    with pytest.raises(po.PolicyError):
        ft.matrix_predictions(*planted(three[0].sparkSession, 12, 6, 3))


def test_importance_in_one_block_and_in_many(three, monkeypatch):
    p, s = three
    for block in (4096, 4):
        monkeypatch.setattr(wf, "BLOCK", block)
        rows = ft.matrix_importance(p, s, trees=50).collect()
        assert sum(r.importance for r in rows) == pytest.approx(1)
        assert {r.feature_id for r in sorted(rows, key=lambda r: -r.importance)[:6]} == {f"P{j:03d}" for j in range(6)}
        again = ft.matrix_importance(p.repartition(7), s, trees=50).collect()
        assert {r.feature_id: round(r.importance, 9) for r in rows} == {r.feature_id: round(r.importance, 9) for r in again}


def test_trees_end_pure_and_a_hopeless_matrix_in_the_shares_of_classes(spark, three):
    p, s = three
    _, _, classes, y = ft._labels(s)
    w = ft._bootstrapped(np.ones(len(y), bool), 20, 1)
    g = wf.grow(mx.vectors(p.filter("grp is not null")), y, len(classes), w, 1)
    assert (g.leaf[g.node].max(-1)[w > 0] == 1).all() and (g.leaf[g.node].argmax(-1) == y)[w > 0].all()
    flat = p.selectExpr("feature_id", "sample", "grp", "1.0D as x").filter("grp is not null")
    g = wf.grow(mx.vectors(flat), y, len(classes), w, 1)
    assert not g.splits and np.allclose(g.leaf[g.node[0, 0]], [w[0, y == c].sum() / w[0].sum() for c in range(3)])


def test_queries_take_more_features_than_a_vector_may_have(spark, monkeypatch):
    monkeypatch.setattr(ft, "FEATURES", 10)
    assert registry.QUERIES["forest_importance"](spark, "/root/testdata/sf0.01").count() == 50
    assert registry.QUERIES["forest_predictions"](spark, "/root/testdata/sf0.01").count() == 25
