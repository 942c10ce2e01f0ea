"""Random forests of a matrix of few samples and any number of features.

A row a sample would hold all features, so trees are grown over rows of features. The features are dealt by hash into blocks of some thousands; a block's values are one row of a table that is written once. All trees of all fits grow one level at a time: each task looks, for every open node, at those of its blocks' features that the node tries, and keeps the best split; the best of all tasks comes back with the samples that go left. The driver holds a node a tree and sample, no feature but those that split. Samples that a tree isn't trained on go down with the others, so no second pass predicts.

A node tries the square root of the features, drawn evenly without replacement: how many fall into each block is drawn by halving the blocks, with generators that every task seeds alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators.written import meanwhile

#: Features of a block, about; levels of a tree; numbers that one step works on; bits of samples that the open nodes of one pass have.
BLOCK, DEPTH, STEP, BITS = 4096, 30, 1 << 22, 1 << 27


@dataclass
class Grown:
    """node: (trees, samples), where each sample ends; leaf: for each node, shares of the classes; splits: (tree, feature_id, drop of impurity, weighted)."""

    node: np.ndarray
    leaf: np.ndarray
    splits: list[tuple[int, str, float]]


def blocks(rows: DataFrame, n: int) -> DataFrame:
    """(block, many, size, names, x): features of a hash range, one of many, n numbers of each in order of sample. n: samples."""
    features = rows.count()
    many = 1 << max(0, int(np.ceil(np.log2(max(1, features) / BLOCK))))

    def pack(t: pa.Table) -> pa.Table:
        x = t["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        if len(x) != n * t.num_rows:
            raise ValueError("a feature lacks a sample")
        return pa.table({"block": t["block"][:1], "many": pa.array([many], pa.int32()), "size": pa.array([t.num_rows], pa.int32()), "names": pa.array([t["feature_id"].to_pylist()], pa.list_(pa.string())), "x": pa.array([x.astype("<f8").tobytes()], pa.binary())})

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("feature_id"), F.lit(many)).cast("int")).repartition("block").sortWithinPartitions("block", "feature_id")
    return dealt.groupBy("block").applyInArrow(pack, "block int, many int, size int, names array<string>, x binary")


def tried(sizes: np.ndarray, block: int, want: np.ndarray, seed: list[int]) -> np.ndarray:
    """How many of a block's features each node tries, of those that it tries in all: the same numbers in every task."""
    low, high = 0, len(sizes)
    while high - low > 1:
        mid = (low + high) // 2
        left, right = int(sizes[low:mid].sum()), int(sizes[mid:high].sum())
        some = np.random.default_rng([*seed, low, high]).hypergeometric(left, right, want) if left and right else want if left else np.zeros_like(want)
        low, high, want = (low, mid, some) if block < mid else (mid, high, want - some)
    return want


def drawn(many: np.ndarray, n: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """(node, place): for each node as many different places below n as asked."""
    got = np.zeros(0, np.int64)
    while (short := many - np.bincount(got // n, minlength=len(many))).any():
        got = np.unique(np.concatenate([got, np.repeat(np.arange(len(many)), short) * n + rng.integers(0, n, short.sum())]))
    return got // n, got % n


def splits(x: np.ndarray, order: np.ndarray, y: np.ndarray, classes: int, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(drop of Gini impurity, place of the last value on the left) of the best split of each row: x ascends by order, w are the samples' weights."""
    v, w, of = np.take_along_axis(x, order, 1), np.take_along_axis(w, order, 1), y[order]
    left = np.stack([np.cumsum(w * (of == c), 1) for c in range(classes)], -1)[:, :-1]
    total = left[:, -1] + (w[:, -1:] * (of[:, -1:] == np.arange(classes)))
    n, nl = w.sum(1), left.sum(-1)
    nr = n[:, None] - nl
    with np.errstate(divide="ignore", invalid="ignore"):
        kept = (left**2).sum(-1) / nl + ((total[:, None] - left) ** 2).sum(-1) / nr
        drop = (kept - ((total**2).sum(-1) / n)[:, None]) / n[:, None]
    drop[(v[:, 1:] == v[:, :-1]) | (nl == 0) | (nr == 0)] = -1
    at = drop.argmax(1)
    return drop[np.arange(len(x)), at], at


def _level(table: DataFrame, sizes: np.ndarray, y: np.ndarray, classes: int, weights: np.ndarray, node: np.ndarray, open_: np.ndarray, tree: np.ndarray, seed: list[int]) -> list:
    """(place in open_, drop, feature_id, left) of the best split of each open node that has one."""
    n = len(y)
    want = np.full(len(open_), max(1, int(np.sqrt(sizes.sum()))))
    per = max(1, STEP // (n * classes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop, tie = np.full(len(open_), 1e-12), np.zeros(len(open_))
        name, left = np.full(len(open_), None, object), np.zeros((len(open_), -(-n // 8)), np.uint8)
        for b in batches:
            for block, names, raw in zip(b["block"].to_pylist(), b["names"], b["x"], strict=True):
                x = np.frombuffer(raw.as_buffer(), "<f8").reshape(-1, n)
                order = np.argsort(x, 1, kind="stable")
                rng = np.random.default_rng([*seed, 1, block])
                at, row = drawn(tried(sizes, block, want, [*seed, 0]), len(x), rng)
                chance = rng.random(len(at))  # equal splits are taken by chance
                for i in range(0, len(at), per):
                    a, r, t = at[i : i + per], row[i : i + per], chance[i : i + per]
                    d, k = splits(x[r], order[r], y, classes, weights[tree[a]] * (node[tree[a]] == open_[a][:, None]))
                    best = np.lexsort((t, d, a))
                    best = best[np.append(a[best][1:] != a[best][:-1], True)]  # the last of each node
                    best = best[(d[best] > drop[a[best]]) | ((d[best] == drop[a[best]]) & (t[best] > tie[a[best]]))]
                    a, r, k, d, t = a[best], r[best], k[best], d[best], t[best]
                    drop[a], tie[a] = d, t
                    last = np.take_along_axis(np.take_along_axis(x[r], order[r], 1), k[:, None], 1)
                    held = weights[tree[a]] * (node[tree[a]] == open_[a][:, None]) > 0
                    inside = np.where(held & (x[r] <= last), x[r], -np.inf).max(1, keepdims=True)
                    after = np.where(held & (x[r] > last), x[r], np.inf).min(1, keepdims=True)
                    cut = inside / 2 + after / 2
                    left[a] = np.packbits(x[r] <= np.where(cut < after, cut, inside), 1)
                    name[a] = np.array([names[int(j)].as_py() for j in r], object)
        some = np.flatnonzero(name != None)  # noqa: E711 - elementwise
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(drop[some]), pa.array(tie[some]), pa.array(name[some].tolist(), pa.string()), pa.array([v.tobytes() for v in left[some]], pa.binary())], ["at", "drop", "tie", "feature_id", "left"])

    found = table.select("block", "names", "x").mapInArrow(run, "at long, drop double, tie double, feature_id string, left binary")
    best = found.groupBy("at").agg(F.max_by(F.struct("drop", "feature_id", "left"), F.struct("drop", "tie", "feature_id")).alias("b"))
    return best.select("at", "b.*").collect()  # a row a node


def grow(p: DataFrame, y: np.ndarray, classes: int, weights: np.ndarray, seed: int) -> Grown:
    """Trees grown until a node is pure. p: profiles of these samples alone; y: their classes in order of name; weights: (trees, samples), how often a tree's sample holds each."""
    trees, n = weights.shape
    weights = weights.astype(np.float64)
    node = np.repeat(np.arange(trees)[:, None], n, 1)
    counts = np.stack([(weights * (y == c)).sum(1) for c in range(classes)], 1)
    tree_of, open_, used = np.arange(trees), np.flatnonzero((counts > 0).sum(1) > 1), []
    with meanwhile(p.select("feature_id", "v"), "profiles") as rows, meanwhile(blocks(rows, n), "forest") as table:
        kept = {r.block: r for r in table.select("block", "many", "size").collect()}  # a row a block
        sizes = np.zeros(next(iter(kept.values())).many if kept else 1, np.int64)
        for b, r in kept.items():
            sizes[b] = r["size"]
        for depth in range(DEPTH if kept else 0):
            rows, turn = [], max(1, BITS // n)
            for i in range(0, len(open_), turn):
                own = open_[i : i + turn]
                rows += [(own[r["at"]], r) for r in _level(table, sizes, y, classes, weights, node, own, tree_of[own], [seed, depth, i])]
            if not rows:
                break
            rows.sort(key=lambda v: v[0])
            at = len(tree_of) + 2 * np.arange(len(rows))
            for k, (o, r) in zip(at.tolist(), rows, strict=True):
                t = tree_of[o]
                left = np.unpackbits(np.frombuffer(r.left, np.uint8), count=n).astype(bool)
                node[t] = np.where(node[t] == o, np.where(left, k, k + 1), node[t])
                used.append((int(t), r.feature_id, float(r["drop"] * counts[o].sum() / counts[t].sum())))
            tree_of = np.append(tree_of, np.repeat(tree_of[[o for o, _ in rows]], 2))
            new = np.zeros((len(tree_of) - len(counts), classes))
            for c in range(classes):
                np.add.at(new[:, c], np.maximum(node - len(counts), 0).ravel(), (weights * (y == c) * (node >= len(counts))).ravel())
            open_ = len(counts) + np.flatnonzero((new > 0).sum(1) > 1)
            counts = np.append(counts, new, 0)
    return Grown(node, counts / np.maximum(counts.sum(1, keepdims=True), 1), used)
