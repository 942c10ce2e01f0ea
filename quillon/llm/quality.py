"""Positive-unlabelled quality classifier.

Trusted positives, unlabelled web text and a class prior are all that the fit sees: a small network of one hidden layer minimises the non-negative unbiased risk prior * R+(positive) + max(0, R-(unlabelled) - prior * R-(positive)) under the logistic loss; where the second term falls below 0 its gradient is reversed. The prior is estimated from positives and unlabelled rows alone: a first network tells the two apart on one half of both, and among the regions above its thresholds on the other half, the least ratio of unlabelled to positive mass is the share of positives in the unlabelled text. The fit uses at most POSITIVES trusted rows and UNLABELLED others, those whose ids hash lowest (of rows that share an id, one), on the driver (some 40 numbers a row); scoring runs over all rows in one pass without a shuffle.

Inputs of a score are shape statistics of the whole text: shares of kinds of characters, word lengths, repetition of words and word triples.

Defined cases: a null text scores as the empty text. Labels that are null are not learnt from. Without positives or other rows every score is 0.5. Texts of any length are read whole. Repeated rows score alike; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import map_batches, rolling, table, text_chunks, within, words

#: Trusted positives and unlabelled rows that the fit reads, at most.
POSITIVES = 20_000
UNLABELLED = 20_000
#: Positives, at least, that lie above a threshold which the prior is estimated at.
ABOVE = 0.3
HIDDEN, EPOCHS, STEPS, PRIOR_STEPS, BATCH, RATE, DECAY = 24, 40, 1500, 600, 512, 3e-3, 1e-4
#: Kinds of bytes: fixed values.
KINDS = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"\n", b".,;:", b"!?", b"|", b"#$%&*@^~=+<>{}[]\\/_", b"'\"()-")
N_FEATURES = len(KINDS) + 13


def _kind_table() -> np.ndarray:
    t = np.full(256, len(KINDS), np.uint8)
    for i, k in enumerate(KINDS):
        t[list(k)] = i
    t[128:] = len(KINDS) + 1
    return t


_KIND = _kind_table()


def features(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A row of N_FEATURES numbers for each text."""
    rows, size = len(off) - 1, np.diff(off)
    h, first, start, end = words(data, off)
    n = np.diff(first)
    doc = np.repeat(np.arange(rows), n)
    some, some_words = np.maximum(size, 1), np.maximum(n, 1)
    kind_doc = np.repeat(np.arange(rows, dtype=np.int64) * 16, size) + _KIND[data]
    kinds = np.bincount(kind_doc, minlength=16 * rows).reshape(rows, 16)[:, : len(KINDS) + 2]
    length = (end - start).astype(float)

    def share(flag: np.ndarray, of: np.ndarray = doc) -> np.ndarray:
        return np.bincount(of, flag, rows)

    again = np.zeros(len(h))
    again[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    pos, tri_doc = within(first, 3)
    tri = rolling(h, 3)[pos] if len(pos) else h[:0]

    def distinct(x: np.ndarray, of: np.ndarray) -> np.ndarray:
        key = x ^ (of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))  # one sort for all texts
        order = np.argsort(key)
        key = key[order]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        return np.bincount(of[order][new], minlength=rows)

    head, tail = (_KIND[data[start]], _KIND[data[end - 1]]) if len(h) else (h[:0], h[:0])
    mean = share(length) / some_words
    cols = [
        np.log1p(size), np.log1p(n), *(kinds[:, i] / (some if i in (0, 1) else some_words) for i in range(len(KINDS))), kinds[:, -1] / some,
        mean / 10, np.sqrt(np.maximum(share(length**2) / some_words - mean**2, 0)) / 10, share(again) / some_words,
        distinct(h, doc) / some_words, distinct(tri, tri_doc) / np.maximum(n - 2, 1), share(head == 0) / some_words,
        share(tail == 3) / some_words, share((tail >= 4) & (tail <= 6)) / some_words, share(length == 1) / some_words, share(length > 20) / some_words,
    ]
    return np.stack(cols, 1)


@dataclass
class Model:
    """Standardisation and weights; score() gives the probability of a positive."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(np.clip((x - self.mean) / self.scale, -6, 6) @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among the unlabelled rows: where none but positives are, unlabelled mass is that share of positive mass."""
    p, u = (x[np.random.default_rng(5).permutation(len(x))] for x in (positive, unlabelled))
    first = fit(p[::2], u[::2], 0.5, steps=PRIOR_STEPS)
    sp, su = np.sort(first.margin(p[1::2])), np.sort(first.margin(u[1::2]))
    if not len(sp) or not len(su):
        return 0.5
    at = np.quantile(sp, np.linspace(0, 1 - ABOVE, 40))
    above_p = 1 - np.searchsorted(sp, at, "left") / len(sp)
    above_u = 1 - np.searchsorted(su, at, "left") / len(su)
    return float(np.clip((above_u / above_p).min(), 0.02, 0.98))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, seed: int = 7, steps: int | None = None) -> Model:
    """Non-negative unbiased risk, by Adam over shuffled batches; so many steps, or EPOCHS and at least STEPS."""
    rng = np.random.default_rng(seed)
    both = np.concatenate([positive, unlabelled])
    mean, scale = both.mean(0), both.std(0) + 1e-6
    xp, xu = (np.clip((x - mean) / scale, -6, 6) for x in (positive, unlabelled))
    w = [rng.normal(0, N_FEATURES**-0.5, (N_FEATURES, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.array(np.log(prior / (1 - prior)))]
    m, v, t = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w], 0
    per = max(1, len(xu) // BATCH)
    epochs = max(EPOCHS, STEPS // per) if steps is None else -(-steps // per)  # small tables get as many steps
    for epoch in range(epochs):
        p_order, u_order = rng.permutation(len(xp)), rng.permutation(len(xu))
        for s in range(per):
            p, u = xp[np.take(p_order, np.arange(s * BATCH, (s + 1) * BATCH), mode="wrap")], xu[np.take(u_order, np.arange(s * BATCH, (s + 1) * BATCH), mode="wrap")]
            x = np.concatenate([p, u])
            a = np.tanh(x @ w[0] + w[1])
            z = a @ w[2] + w[3]
            q = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            np_, nu = len(p), len(u)
            negative = np.log1p(np.exp(np.clip(z[np_:], -30, 30))).mean() - prior * np.log1p(np.exp(np.clip(z[:np_], -30, 30))).mean()
            g = np.zeros(len(x))
            if negative >= 0:
                g[:np_] = prior * ((q[:np_] - 1) - q[:np_]) / np_
                g[np_:] = q[np_:] / nu
            else:  # leave the overfitted part of the risk
                g[:np_] = prior * q[:np_] / np_
                g[np_:] = -q[np_:] / nu
            back = np.outer(g, w[2]) * (1 - a * a)
            grads = [x.T @ back + DECAY * w[0], back.sum(0), a.T @ g + DECAY * w[2], g.sum()]
            t += 1
            rate = RATE * (1 - epoch / epochs) + 1e-5
            for i, d in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * d
                v[i] = 0.999 * v[i] + 0.001 * d * d
                w[i] = w[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return Model(mean, scale, w[0], w[1], w[2], float(w[3]))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose labels are never learnt from: crc32 of the id as text is 2 modulo 4. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _sample(docs: DataFrame, ids: DataFrame, n: int) -> np.ndarray:
    """Features of the n ids that hash lowest; n bounds what is broadcast and collected."""
    low = ids.select("doc_id").distinct().orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(n)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        x = np.concatenate([features(data, off) for _, _, data, off in text_chunks(b.column(1))])
        return pa.RecordBatch.from_arrays([b.column(0), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), N_FEATURES).cast(pa.list_(pa.float64()))], ["doc_id", "x"])

    rows = map_batches(docs.join(F.broadcast(low), "doc_id").select("doc_id", "text"), run, "doc_id long, x array<double>")
    got = rows.groupBy("doc_id").agg(F.min("x").alias("x")).orderBy("doc_id").toArrow()
    flat = got.column("x").combine_chunks()
    return np.asarray(flat.flatten() if len(flat) else []).reshape(-1, N_FEATURES)


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """docs: (doc_id, text); labels: (doc_id, quality), of which only the positives are read."""
    trusted = labels.filter((F.col("quality") == 1) & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id")
    xp = _sample(docs, trusted, positives)
    xu = _sample(docs, docs.filter(F.col("doc_id").isNotNull() & ~held_out()), unlabelled)
    if not len(xp) or not len(xu):
        return Model(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros((N_FEATURES, 1)), np.zeros(1), np.zeros(1), 0.0)
    return fit(xp, xu, estimate_prior(xp, xu))


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        s = np.concatenate([model.score(features(data, off)) for _, _, data, off in text_chunks(b.column(1))])
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(s)], ["doc_id", "score"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, score double")


def accept(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """docs with its own columns, without the rows that score below the threshold."""
    at = docs.columns.index("text")

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        s = np.concatenate([model.score(features(data, off)) for _, _, data, off in text_chunks(b.column(at))])
        return b.filter(pa.array(s >= threshold))

    return map_batches(docs, run, docs.schema)


def op9_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return scores(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
