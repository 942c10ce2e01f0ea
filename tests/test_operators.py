"""Operators and kernels on small matrices."""

import inspect
import math

import numpy as np
import pytest

from pyspark.sql import functions as F

from quillon.functions import kernels, stats, text
from quillon.operators import differential as diff
from quillon.operators import matrix as mx
from quillon.operators import places
from quillon.operators import policy as po
from quillon.operators import profile as pf
from quillon.operators import reduce as rd
from quillon.operators import select as sl
from quillon.operators import sets as st
from quillon.plans import registry


def matrix(spark, x, groups):
    samples = spark.createDataFrame([(f"S{j + 1:02d}", g, j, sorted(set(groups)).index(g)) for j, g in enumerate(groups)], "sample string, grp string, sample_ord int, group_ord int")
    rows = [(f"P{i + 1:03d}", f"S{j + 1:02d}", groups[j], float(v), float(v)) for i, r in enumerate(x) for j, v in enumerate(r) if not math.isnan(v)]
    return spark.createDataFrame(rows, "feature_id string, sample string, grp string, value double, ident double"), samples


def planted(rows=120, seed=3):
    rng = np.random.default_rng(seed)
    groups = ["A"] * 10 + ["B"] * 10
    x = np.exp(rng.normal(4, 0.4, (rows, 20)))
    x[:10, :10] *= 8
    return x, groups


def test_prepared_drops_and_fills(spark):
    nan = float("nan")
    q, s = matrix(spark, [[1, nan, 3, 7], [nan, nan, nan, 1], [0, 0, 0, 0]], ["A", "A", "B", "B"])
    got = {(r.feature_id, r.sample): r.x for r in mx.prepared(mx.dense(q, s), 0.5).collect()}
    assert len(got) == 8 and got[("P001", "S02")] == pytest.approx(2.0)
    z = mx.z_scores(mx.prepared(mx.dense(q, s), 0.5)).filter("feature_id = 'P003'").collect()
    assert {r.z for r in z} == {0.0}
    assert mx.dense(q.limit(0), s).count() == 0


def test_sets(spark):
    q, _ = matrix(spark, [[1, 1, float("nan")], [1, float("nan"), 1]], ["A", "B", "C"])
    s = st.group_sets(q)
    assert {(r.combo, r.proteins) for r in st.intersections(s, ["A", "B", "C"]).collect()} == {("110", 1), ("101", 1)}
    with pytest.raises(ValueError, match="no group has proteins"):
        st.check_groups({"A": 0, "B": 0})


def test_tests_find_planted_features(spark):
    x, groups = planted()
    q, _ = matrix(spark, x, groups)
    two = diff.two_groups(q, "A", "B")
    for t in (diff.welch(two), diff.moderated(two)):
        r = diff.adjusted(t.withColumn("p", diff.p_value("t", "df"))).filter("q < 0.01").collect()
        assert {f"P{i + 1:03d}" for i in range(10)} <= {x.feature_id for x in r} and len(r) < 20


def test_adjusted_equals_the_definition(spark):
    p = [0.01, 0.03, 0.04, 0.04, 0.9, 1e-9, 0.5, None]
    df = spark.createDataFrame([(f"f{i}", v) for i, v in enumerate(p)], "feature_id string, p double")
    own = sorted(v for v in p if v is not None)
    want = {v: min(1, min(own[j] * len(own) / (j + 1) for j in range(len(own)) if own[j] >= v)) for v in own}
    for r in diff.adjusted(df).collect():
        assert r.q == pytest.approx(want[r.p])


def test_distributions():
    assert stats.t_two_sided(np.array([2.0, 0.0, -12.706]), np.array([10.0, 5.0, 1.0])) == pytest.approx([0.0733880, 1.0, 0.05], abs=1e-5)
    assert stats.digamma(1) == pytest.approx(-0.5772156649) and stats.trigamma(1) == pytest.approx(math.pi**2 / 6)
    assert stats.inverse_trigamma(stats.trigamma(3.3)) == pytest.approx(3.3)


def test_pca_equals_svd(spark):
    x, groups = planted(60)
    q, s = matrix(spark, x, groups)
    got = np.array([[r.pc1, r.pc2] for r in rd.pca(mx.prepared(mx.dense(q, s), 0.5), s).orderBy("sample").collect()])
    y = np.log2(x + 1).T
    y = (y - y.mean(0)) / y.std(0, ddof=1)
    u, d, _ = np.linalg.svd(y, full_matrices=False)
    assert np.abs(got) == pytest.approx(np.abs(u[:, :2] * d[:2]), abs=1e-4)


def test_layouts_keep_groups_apart(spark):
    x, groups = planted(200)
    x[:60, :10] *= 6
    q, s = matrix(spark, x, groups)
    p = mx.prepared(mx.dense(q, s), 0.5)
    for df in (rd.tsne(p, s, steps=300), rd.umap(p, s)):
        rows = df.orderBy("sample").collect()
        y = np.array([[r[2], r[3]] for r in rows])
        d = np.sqrt(((y[:, None] - y[None]) ** 2).sum(-1))
        assert np.isfinite(y).all()
        np.fill_diagonal(d, np.inf)
        assert np.mean([groups[i] == groups[j] for i, j in enumerate(d.argmin(1))]) > 0.9


def test_clusters_and_correlation(spark):
    x, groups = planted(80)
    q, s = matrix(spark, x, groups)
    p = mx.prepared(mx.dense(q, s), 0.5)
    c = {(r.sample1, r.sample2): r.correlation for r in pf.correlation(p, s).collect()}
    want = np.corrcoef(np.log2(x + 1).T)
    assert c[("S01", "S12")] == pytest.approx(want[0, 11], abs=1e-5)
    assert len({r.cluster for r in rd.sample_clusters(p, s, 3).collect()}) == 3
    order, label = kernels.linkage_order(np.array([[0, 1, 9], [1, 0, 8], [9, 8, 0.0]]), 2)
    assert label[0] == label[1] != label[2] and sorted(order) == [0, 1, 2]


def test_tsne_takes_all_steps(spark, monkeypatch):
    x, groups = planted(60)
    q, s = matrix(spark, x, groups)
    asked, own = [], kernels.tsne
    monkeypatch.setattr(rd.kernels, "tsne", lambda d2, start, perplexity, steps=1000: asked.append(steps) or own(d2, start, perplexity, steps))
    assert rd.tsne(mx.prepared(mx.dense(q, s), 0.5), s).count() == 20 and asked == [1000]


def test_trajectory_orders_stages(spark):
    rng = np.random.default_rng(5)
    groups = [f"T{i}" for i in range(4) for _ in range(6)]
    stage = np.repeat(np.arange(4), 6)
    x = np.exp(rng.normal(3, 0.15, (150, 24)) + np.outer(rng.choice([0.5, -0.5], 150), stage))
    q, s = matrix(spark, x, groups)
    p = mx.prepared(mx.dense(q, s), 0.5)
    t = rd.pseudotime(p, s, "T0").orderBy("sample").collect()
    assert {r.lineage for r in t} == {1}
    means = [np.mean([r.pseudotime for r in t if r.grp == f"T{i}"]) for i in range(4)]
    assert means == sorted(means)
    r = rd.rank_correlation(p, rd.pseudotime(p, s, "T0").select("sample", F.col("pseudotime").alias("t"))).filter("abs(rho) > 0.8").count()
    assert r > 120


def test_selection_finds_planted_features(spark):
    x, groups = planted(150)
    q, s = matrix(spark, x, groups)
    f = mx.filtered(mx.dense(q, s), 0.5)
    t = sl.stability(sl.fits(f, s, repeats=4, top_var=60, trees=30), f, 4)
    best = [r.feature_id for r in sl.ranked(t, "combined_score", 10).orderBy("rank").collect()]
    assert len({*best} & {f"P{i + 1:03d}" for i in range(10)}) >= 8
    lists = [("rf", spark.createDataFrame([(1, "A"), (2, "B")], "rank int, feature_id string")), ("l1", spark.createDataFrame([(1, "B"), (2, "C")], "rank int, feature_id string"))]
    assert [(r.feature_id, r.source) for r in sl.union_of(lists).collect()] == [("A", "rf"), ("B", "rf"), ("C", "l1")]


def test_selection_does_the_whole_job(spark, monkeypatch):
    """By default 50 repeats of 500 trees over 200 features, also those of little variance; blocks of trees add up."""
    x, groups = planted(150)
    x[:10] = np.exp(np.log(x[:10]).mean(1, keepdims=True) + 0.1 * (np.log(x[:10]) - np.log(x[:10]).mean(1, keepdims=True)))
    q, s = matrix(spark, x, groups)
    f = mx.filtered(mx.dense(q, s), 0.5)
    rows = sl.fits(f, s, repeats=2, trees=60).collect()
    assert len(rows) == 2 * 150
    assert len({r.feature_id for r in rows if r.gini_rank <= 10} & {f"P{i + 1:03d}" for i in range(10)}) >= 6
    default = {k: v.default for k, v in inspect.signature(sl.fits).parameters.items()}
    assert (default["repeats"], default["top_var"], default["trees"], default["folds"]) == (50, 200, 500, "Auto")
    asked = []
    monkeypatch.setattr(registry.bridge, "samples", lambda *_: s)
    monkeypatch.setattr(registry.mx, "filtered", lambda *_: f)
    monkeypatch.setattr(registry, "dense", lambda *_: None)
    monkeypatch.setattr(sl, "fits", lambda *a, **k: asked.append(a[2]) or spark.createDataFrame(rows))
    assert sl.fits is registry.sl.fits and registry._stability(spark, "") is not None and asked == [50]


def test_penalty_solves_its_problem():
    """The fit is at the optimum: slopes are at most the penalty, and equal it where a coefficient isn't 0."""
    rng = np.random.default_rng(3)
    y = np.repeat(np.arange(3), 7)
    z = rng.normal(size=(21, 60))
    z[:, :4] += y[:, None]
    z = (z - z.mean(0)) / z.std(0)
    w, b = kernels.elastic_net(z, y, 3, 0.03)
    e = np.exp(z @ w + b)
    slope = z.T @ (e / e.sum(1, keepdims=True) - np.eye(3)[y]) / 21
    assert np.abs(slope).max() < 0.03 * 1.001 and np.abs(slope + 0.03 * np.sign(w))[w != 0].max() < 1e-4
    lam = kernels.chosen_lambda(z, y, 3, np.arange(21) % 7 % 5)
    top = np.abs(z.T @ (np.eye(3)[y] - 1 / 3)).max() / 21
    place = np.log(lam / top) / np.log(0.01) * 99
    assert place == pytest.approx(round(place), abs=1e-6)


def test_text(spark):
    rows = [("sp|P1|A_X more;x", "12.5", "1d", "MKV*", "TRANSMEM 5..9"), (" NA ", "Inf", "1e3", "", None), ("Q2|B_Y", None, ".5", "aaa", "nucleus")]
    df = spark.createDataFrame(rows, "a string, n string, m string, s string, t string")
    c = F.col
    out = df.select(text.clean_accession(c("a")), text.entry_name(c("a")), text.number(c("n")), text.number(c("m")), text.gravy(c("s")), text.tm_count(c("t")), text.subcellular_class(c("t"), F.lit(0))).collect()
    assert tuple(out[0])[:4] == ("P1", "A_X", 12.5, None) and tuple(out[1])[:4] == (None, None, None, 1000.0) and tuple(out[2])[:4] == ("Q2", "B_Y", None, 0.5)
    assert out[0][4] == pytest.approx((1.9 - 3.9 + 4.2) / 3) and out[1][4] is None and [r[5] for r in out] == [1, 0, 1] and out[2][6] == "Nucleus"


def test_stream_counts(spark, tmp_path):
    from quillon.streaming import drop_folder

    row = spark.createDataFrame([("f", "s", "g", 1.0, None)], "feature_id string, sample string, grp string, value double, ident double").withColumn("arrived", F.lit("2024-01-01 00:01:00").cast("timestamp"))
    row.write.parquet(str(tmp_path / "in"))
    q = drop_folder.counts(drop_folder.cells(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("drops").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    assert [(r.sample, r.identified, r.quantified) for r in spark.table("drops").collect()] == [("s", 0, 1)]


def counts(spark, **n):
    return spark.createDataFrame([(k,) for k, m in n.items() for _ in range(m)] + [(None,)], "y string")


def test_decisions(spark):
    def decide(analysis, how=None, **n):
        return po.decision(counts(spark, **n), analysis, **(how or {})).first()

    d = decide("forest", a=8, b=9)
    assert (d.classes, d.smallest, d.smallest_n, d.folds, d.grouped, d.holds_out, d.accepted, d.reason) == (2, "a", 8, 5, True, True, True, None)
    d = decide("forest", a=8, b=7)
    assert d.accepted and not d.holds_out and "b has 7" in d.reason
    d = decide("forest", {"mode": "train test split"}, a=8, b=7)
    assert not d.accepted and "8 samples" in d.reason
    d = decide("forest", {"mode": "Cross-validation only"}, a=99, b=99)
    assert d.accepted and not d.holds_out and d.reason is None
    d = decide("forest", a=5, b=6)
    assert not d.accepted and "6 samples" in d.reason and "a has 5" in d.reason
    d = decide("forest", {"exploratory": True}, a=2, b=6)
    assert d.accepted and d.folds == 2 and not d.holds_out and not d.grouped
    assert not decide("forest", {"exploratory": True}, a=9).accepted
    assert not decide("sparse", {"exploratory": True}, a=4, b=9).accepted
    d = decide("sparse", {"exploratory": True}, a=5, b=9)
    assert d.accepted and d.folds == 5
    assert decide("sparse", {"folds": "7"}, a=12, b=12).folds == 7
    assert "folds" in decide("sparse", {"folds": 3}, a=12, b=12).reason
    assert not po.decision(spark.createDataFrame([], "y string"), "sparse").first().accepted
    with pytest.raises(po.PolicyError):
        po.decision(counts(spark, a=9, b=9), "forest", mode="halves")
    with pytest.raises(po.PolicyError, match="6 samples"):
        po.demanded(counts(spark, a=5, b=6), "forest")


def test_settings_and_names(spark):
    assert po.setting(" Auto ", 7) == 7 and po.setting("3") == 3 and po.setting(None) is None and po.setting(4.0) == 4
    for bad in ("0", "-1", "x", "inf"):
        with pytest.raises(po.PolicyError):
            po.setting(bad)
    assert po.inner_folds(9) == 5 and po.inner_folds(4) == 4
    with pytest.raises(po.PolicyError):
        po.inner_folds(3)
    assert po.clusters("9", 4) == 4
    for bad in (None, 0):
        with pytest.raises(po.PolicyError):
            po.clusters(bad, 4)
    ok = spark.createDataFrame([("s1", "a"), ("s2", "b")], "sample string, display_name string")
    assert po.display_names(ok) is ok
    for twice in ("a", "", None):
        with pytest.raises(po.PolicyError, match="2 samples|no name"):
            po.display_names(spark.createDataFrame([("s1", twice), ("s2", twice)], "sample string, display_name string"))
    assert po.slug("Random forest (RF)!") == "random_forest_rf" and po.slug("") == "ml"


def test_fits_and_trajectories_ask_the_policy(spark):
    x, _ = planted(20)
    groups = ["A"] * 3 + ["B"] * 17
    q, s = matrix(spark, x, groups)
    f = mx.filtered(mx.dense(q, s), 0.5)
    with pytest.raises(po.PolicyError, match="A has 3"):
        sl.fits(f, s, 2, exploratory=True)
    q, s = matrix(spark, x, ["A" if i < 5 else "B" for i in range(20)])
    with pytest.raises(po.PolicyError, match="6 samples"):
        sl.fits(mx.filtered(mx.dense(q, s), 0.5), s, 2)
    with pytest.raises(po.PolicyError, match="3 training"):
        sl.fits(mx.filtered(mx.dense(q, s), 0.5), s, 2, share=0.5, exploratory=True)
    p = mx.prepared(mx.dense(q, s), 0.5)
    for start, end in (("C", None), ("A", "C")):
        with pytest.raises(po.PolicyError, match="group C"):
            rd.pseudotime(p, s, start, end)
    with pytest.raises(po.PolicyError, match="proteins"):
        rd.pseudotime(p.filter("feature_id < 'P003'"), s, "A")
    assert {r.grp for r in rd.pseudotime(p, s, "A", "B").collect()} == {"A", "B"}
    with pytest.raises(ValueError, match="2 features"):
        rd.pca(p.filter("feature_id = 'P001'"), s)


def test_adjustment_where_half_of_all_p_are_0(spark):
    rng = np.random.default_rng(4)
    p = np.where(rng.random(5000) < 0.5, 0.0, rng.random(5000) ** 3)
    df = spark.createDataFrame([(f"P{i:05d}", float(v)) for i, v in enumerate(p)] + [("none", None)], "feature_id string, p double").repartition(3)
    order = np.argsort(p, kind="stable")
    q = np.minimum.accumulate((p[order] * len(p) / np.arange(1, len(p) + 1))[::-1])[::-1]
    want = {f"P{i:05d}": min(1.0, v) for i, v in zip(order.tolist(), q.tolist(), strict=True)}
    got = {r.feature_id: r.q for r in diff.adjusted(df).collect()}
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-12
    s, _ = places.sliced(df.filter("p is not null"), [], [F.col("p"), F.col("feature_id")])
    assert s.groupBy("slice_").count().agg(F.max("count")).first()[0] < 5000 * 0.06


def test_rank_correlation_p():
    """Against all orders of few values, and against counted distributions where the series takes over."""
    from itertools import permutations

    for n in (4, 6):
        ranks = np.arange(n)
        sums = np.array([((ranks - np.array(o)) ** 2).sum() for o in permutations(range(n))])
        assert (np.bincount(sums, minlength=(n**3 - n) // 3 + 1) == stats.squared_differences(n)).all()
        for d in set(sums):
            rho = 1 - 6 * d / (n**3 - n)
            want = min(1, 2 * min((sums >= d).mean(), (sums <= d).mean()))
            assert stats.rank_correlation_p([rho], [n], [False])[0] == pytest.approx(want)
    ways = stats.squared_differences(10)
    upper = np.cumsum(ways[::-1])[::-1] / ways.sum()
    for d in (0, 60, 164, 166, 250, 330):
        want = min(1, 2 * (upper[d] if d > 165 else 1 - upper[d + 2]))
        assert stats.rank_correlation_p([1 - 6 * d / 990], [10], [False])[0] == pytest.approx(want, abs=2e-3)
    t = stats.rank_correlation_p([0.5, 1.0], [12, 12], [True, True])
    assert t[0] == pytest.approx(stats.t_two_sided(0.5 * math.sqrt(10 / 0.75), 10)) and t[1] == 0


def test_heatmap_orders(spark):
    x, groups = planted(30)
    q, s = matrix(spark, x, groups)
    p = mx.prepared(mx.dense(q, s), 0.5)
    values, rows, cols = rd.heatmap(p, s, 12, "kmeans", "kmeans", 2, 2)
    r = rows.orderBy("row_order").collect()
    assert [x.row_order for x in r] == list(range(1, 13)) and [x.kmeans_cluster for x in r] == sorted(x.kmeans_cluster for x in r)
    for k in (1, 2):
        own = [x.feature_id for x in r if x.kmeans_cluster == k]
        assert own == sorted(own)
    c = cols.orderBy("col_order").collect()
    assert {x.sample: x.kmeans_cluster for x in c} == {f"S{j + 1:02d}": 1 if j < 10 else 2 for j in range(20)} and [x.sample for x in c] == [f"S{j + 1:02d}" for j in range(20)]
    assert values.count() == 12 * 20
    with pytest.raises(ValueError):
        rd.heatmap(p.filter("feature_id = 'P001'"), s)
    with pytest.raises(ValueError):
        rd.heatmap(p, s, rows="tree")


def test_selected_features(spark):
    x, groups = planted(20)
    q, s = matrix(spark, x, groups)
    p = mx.prepared(mx.dense(q, s), 0.5)
    lists = [("rf", spark.createDataFrame([("P003", 1), ("P001", 2), ("gone", 3)], "feature_id string, rank int")), ("l1", spark.createDataFrame([("P001", 1), ("P009", 2)], "feature_id string, rank int"))]
    got = {(r.feature_id, r.source, r.place) for r in sl.selected(p, lists).collect()}
    assert got == {("P003", "rf", 1), ("P001", "rf", 2), ("P009", "l1", 4)}
    with pytest.raises(ValueError, match="two"):
        sl.selected(p, [("rf", lists[0][1].filter("rank = 1"))])


def test_properties_and_classes(spark):
    from quillon.functions import text

    seqs = ["ACDEFGHIKLMNPQRSTVWY", "KKKKKK", "DDDD", "GGG", ""]
    rows = spark.createDataFrame([(s,) for s in seqs], "s string").select("s", text.isoelectric_point(F.col("s")).alias("p")).collect()
    got = {r.s: r.p for r in rows}

    def charge(s, ph):
        plus = 1 / (1 + 10 ** (ph - 8.6)) + sum(s.count(k) / (1 + 10 ** (ph - v)) for k, v in {"H": 6.5, "K": 10.8, "R": 12.5}.items())
        return plus - 1 / (1 + 10 ** (3.6 - ph)) - sum(s.count(k) / (1 + 10 ** (v - ph)) for k, v in {"D": 3.9, "E": 4.1, "C": 8.5, "Y": 10.1}.items())

    assert got[""] is None and all(abs(charge(s, got[s])) < 1e-6 for s in seqs[:4]) and got["KKKKKK"] > 11 and got["DDDD"] < 4
    places = [("Mitochondrion", 0, "Mitochondria"), ("nucleotide pool", 0, "Other/Unknown"), ("Nuclear pore", 0, "Nucleus"), (None, 2, "Membrane"), ("cytosol", 3, "Cytoplasm")]
    df = spark.createDataFrame(places, "c string, tm int, want string")
    assert all(r.got == r.want for r in df.select("want", text.subcellular_class(F.col("c"), F.col("tm")).alias("got")).collect())


def test_volcano_contract(spark):
    from quillon.operators import differential as diff

    rows = [(f"F{i}", f"{g}{k}", g, 100.0 * (1 + (4 if g == "B" and i == 0 else 0)) + 3 * k + i) for i in range(12) for g in "AB" for k in range(4)]
    q = spark.createDataFrame(rows, "feature_id string, sample string, grp string, value double")
    for test in ("limma", "t_test"):
        v = diff.volcano(q, "A", "B", test=test, metric="adj_p")
        assert len(v.columns) == 15
        assert {r.ProteinID: r.Regulation for r in v.collect()} == {f"F{i}": "Up" if i == 0 else "NotSig" for i in range(12)}
    with pytest.raises(ValueError):
        diff.volcano(q.filter("sample <> 'A1' and sample <> 'A2' and sample <> 'A3'"), "A", "B")


def test_trajectory_tables(spark):
    from quillon.operators import reduce as rd

    order = spark.createDataFrame([("a", "G1", 1, 0.5), ("b", "G1", 1, 0.1), ("c", "G2", 1, 2.0)], "sample string, grp string, lineage int, pseudotime double")
    assert [r.sample for r in rd.in_pseudotime(order).orderBy("place").collect()] == ["b", "a", "c"]
    assert rd.lineage_paths(order).first().path == "G1 -> G2"
    xy = spark.createDataFrame([("a", 1.0), ("z", 2.0)], "sample string, umap1 double")
    assert {r.sample: r.pseudotime for r in rd.with_pseudotime(xy, order).collect()} == {"a": 0.5, "z": None}


def test_ranked_lists(spark):
    """Only features that some component selects, by score, then by frequencies and importance, then by name."""
    cols = "feature_id string, top20_frequency double, top50_frequency double, l1_frequency double, mean_gini double, score double"
    rows = [("P5", 0.0, 0.0, 0.0, 0.0, 9.0), ("P4", 0.0, 0.0, 0.2, 0.0, 0.5), ("P3", 0.1, 0.2, 0.0, 0.3, 0.5), ("P2", 0.1, 0.2, 0.0, 0.4, 0.5), ("P1", 0.1, 0.3, 0.0, 0.1, 0.5), ("P0", 0.2, 0.0, 0.0, 0.0, 0.5), ("P6", 0.0, 0.0, 0.2, 0.0, 0.5), ("P7", 0.0, 0.1, 0.0, 0.0, 0.7)]
    s = spark.createDataFrame(rows, cols)
    got = sl.ranked(s, "score").orderBy("rank").collect()
    assert [r.feature_id for r in got] == ["P7", "P0", "P1", "P2", "P3", "P4", "P6"] and [r["rank"] for r in got] == list(range(1, 8))
    assert [r.feature_id for r in sl.ranked(s, "l1_frequency", 2).orderBy("rank").collect()] == ["P4", "P6"]


def test_perplexity():
    assert [kernels.perplexity_for(n, None) for n in (4, 24, 200)] == [1, 7, 30] and kernels.perplexity_for(24, 5) == 5 and kernels.perplexity_for(24, 50) == 7


def test_coordinates_have_their_groups(spark):
    x, groups = planted(30)
    q, s = matrix(spark, x, groups)
    got = rd.pca(mx.prepared(mx.dense(q, s), 0.5), s)
    assert got.columns == ["sample", "grp", "pc1", "pc2"] and {r.sample: r.grp for r in got.collect()} == {f"S{j + 1:02d}": g for j, g in enumerate(groups)}
