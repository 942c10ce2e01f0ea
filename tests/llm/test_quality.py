"""Quality classifier: held-out accuracy and odd input."""

import zlib

import numpy as np

from quillon.llm import quality

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    rows = quality.op9_pu_quality(spark, SF).collect()
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(rows) == 1000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    own = [r for r in rows if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in own]) > 0.93


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "word"), (3, "word"), (None, " \n"), (5, "x" * 100_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (3, 1), (5, 0), (7, None)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    rows = quality.scores(docs, model).collect()
    assert len(rows) == 6 and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id == 3}) == 1
    none = quality.train(docs.limit(0), labels.limit(0))
    assert quality.scores(docs.limit(0), none).count() == 0
    assert quality.scores(docs, none).first().score == 0.5
    assert quality.accept(docs.withColumn("score", quality.F.lit("x")), none, 0.4).count() == 6


def test_prior_from_positives_and_unlabelled_rows():
    rng = np.random.default_rng(1)
    for share in (0.3, 0.7):
        p = rng.normal(1.2, 1, (4000, quality.N_FEATURES))
        is_p = rng.random(6000) < share
        u = np.where(is_p[:, None], rng.normal(1.2, 1, (6000, quality.N_FEATURES)), rng.normal(-1.2, 1, (6000, quality.N_FEATURES)))
        assert abs(quality.estimate_prior(p, u) - share) < 0.06
