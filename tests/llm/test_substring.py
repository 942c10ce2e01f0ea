"""Substring dedup against a plain scan."""

import hashlib
import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import substring
from quillon.llm.common import words


def passages(seed):
    rng = random.Random(seed)
    words = [f"w{i}é" for i in range(40)]
    shared = [[rng.choice(words) for _ in range(rng.randrange(15, 60))] for _ in range(5)]
    texts = {}
    for i in range(80):
        own = []
        for _ in range(rng.randrange(4)):
            own += [rng.choice(words) for _ in range(rng.randrange(30))] + rng.choice(shared)
        texts[i] = "".join(w + rng.choice([" ", "\n", "  ", "\t "]) for w in own)
    return texts | {100: None, 101: "", 102: " \n", 103: "a", 104: "x " * 300, 105: "x " * 300}


@pytest.mark.parametrize("width", [3, 20])
def test_equals_plain_scan(spark, width):
    texts = passages(width)
    df = spark.createDataFrame([(i, t, "", 1) for i, t in texts.items()], "doc_id long, text string, doc string, tag int").repartition(3)
    want = brute.uncovered(texts, width)
    rows = substring.dedup(df, width).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in rows} == {i: (n, g, " ".join(k)) for i, (n, g, k) in want.items()}
    assert len(rows) == len(texts)


def test_digest_empty_and_repeated_rows(spark):
    schema = "doc_id long, text string"
    assert substring.digest(spark.createDataFrame([], schema)).count() == 0
    same = " ".join(map(str, range(30)))
    rows = substring.digest(spark.createDataFrame([(1, same), (1, same), (None, same), (0, None)], schema)).collect()
    got = sorted((r.doc_id is None, r.doc_id, r.n_removed) for r in rows)
    assert got == [(False, 0, 0), (False, 1, 0), (False, 1, 0), (True, None, 30)]
    assert {r.kept_sha256 for r in rows if r.doc_id == 1} == {hashlib.sha256(same.encode()).hexdigest()}


def test_windows_of_one_hash_are_told_apart(monkeypatch):
    """With a hash of 8 values nearly all windows collide."""
    rng = random.Random(1)
    texts = {i: " ".join(rng.choice("abcd") for _ in range(60)) for i in range(30)}
    blobs = []
    for i, t in texts.items():
        h, first, start, end = words(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]))
        one = np.array([0])
        blobs.append(substring.Blob.pack(np.array([i]), np.array([0]), one, np.array([len(h) - 4]), [t.encode()]))
    plain = substring.bucket_repeats(blobs, 5)
    rolling = substring.rolling
    monkeypatch.setattr(substring, "rolling", lambda h, k: rolling(h, k) % np.uint64(8))
    for a, b in zip(plain, substring.bucket_repeats(blobs, 5), strict=True):
        assert a.tolist() == b.tolist()
    assert len(plain[0])


def test_heavy_minimisers_change_nothing(spark, monkeypatch):
    rng = random.Random(2)
    texts = {i: " ".join([*(rng.choice("abcdefgh") for _ in range(rng.randrange(40))), *"p q r s t u v".split(), *(rng.choice("abcdefgh") for _ in range(rng.randrange(30)))]) for i in range(80)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    monkeypatch.setattr(substring, "RARE", 1)
    own = df.select(F.col("doc_id").alias("doc"), "text")
    assert len(substring.heavy_minimisers(own, 6, 64)) > 3
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring.dedup(df, 6).collect()}
    assert got == {i: (n, k, " ".join(w)) for i, (n, k, w) in brute.uncovered(texts, 6).items()}


def test_very_long_text(spark):
    text = "some words that come again and again " * 40_000
    out = substring.dedup(spark.createDataFrame([(1, text)], "doc_id long, text string"), 20).collect()[0]
    assert out.n_words == 280_000 and out.n_removed == 280_000 - 7  # all but the first round of words lies in a window that starts earlier too


@pytest.mark.parametrize("id_", [None, 7])
def test_texts_of_one_id_that_share_a_tag(spark, monkeypatch, id_):
    """With the first draw all tags are equal: the second must tell the texts apart."""
    tag, drawn = substring._tag, []

    def weak(text, unnamed, seed):
        drawn.append(seed)
        return F.lit(5).cast("long") if seed == 0 else tag(text, unnamed, seed)

    monkeypatch.setattr(substring, "_tag", weak)
    once, twice = (" ".join(f"{k}{i}" for i in range(25)) for k in "ab")
    rows = [(id_, once), (id_, twice), (3, twice), (id_, None)]
    got = sorted((r.n_words, r.n_removed) for r in substring.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, 0), (25, 0), (25, 0), (25, 25)] and drawn == [0, 1]


def test_ids_that_differ_need_no_tags(spark, monkeypatch):
    monkeypatch.setattr(substring, "_tag", lambda text, unnamed, seed: F.lit(5).cast("long"))
    same = " ".join(map(str, range(25)))
    got = substring.digest(spark.createDataFrame([((1 << 63) - 1, same), (2, same)], "doc_id long, text string")).collect()
    assert {r.doc_id: r.n_removed for r in got} == {(1 << 63) - 1: 25, 2: 0}


def test_the_largest_id_is_not_a_missing_one(spark):
    same = " ".join(map(str, range(25)))
    got = substring.digest(spark.createDataFrame([((1 << 63) - 1, same), (None, same)], "doc_id long, text string")).collect()
    assert sorted(r.n_removed for r in got) == [0, 25]


def test_the_sample_of_heavy_minimisers_grows_with_the_buckets(spark, monkeypatch):
    monkeypatch.setattr(substring, "SAMPLE", 40)
    monkeypatch.setattr(substring, "PER_BUCKET", 2)
    monkeypatch.setattr(substring, "RARE", 5)
    frame = " ".join(f"common{i}" for i in range(12))
    rows = [(i, f"own{i} {frame} other{i} " + " ".join(f"w{i}x{j}" for j in range(30))) for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert not len(substring.heavy_minimisers(docs.filter("false"), 10, 8))
    few, many = (substring.heavy_minimisers(docs, 10, b) for b in (8, 400))
    assert len(many) >= len(few)
    assert set(few.tolist()) <= set(many.tolist())
    assert len(many)  # 840 of 1200 texts are looked at, and each holds the frame
