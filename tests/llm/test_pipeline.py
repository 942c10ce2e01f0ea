"""The pipeline, stage by stage, against plain versions."""

import brute
import numpy as np
import pyarrow as pa

import corpus_pipeline
from quillon.llm import pii, quality
from quillon.llm.common import text_chunks

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    step = dict(corpus_pipeline.STAGES)
    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "personal data", "mixing to target weights", "best-fit packing"]

    model = quality.train(docs.select("doc_id", "text"), spark.read.parquet(f"{SF}/labels.parquet"))
    rows = docs.collect()
    score = np.concatenate([model.score(quality.features(d, o)) for _, _, d, o in text_chunks(pa.array([r.text for r in rows]))])
    good = step["quality classifier"](spark, docs, SF)
    assert good.columns == columns
    kept = sorted(r.doc_id for r in good.collect())
    assert kept == sorted(r.doc_id for r, s in zip(rows, score, strict=True) if s >= 0.7)
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert np.mean([i in set(kept) for i, q in truth.items() if q == 1]) > 0.95

    one = step["n-gram Jaccard join"](spark, good, SF)
    own = {r.doc_id: r.text for r in rows if r.doc_id in set(kept)}
    left = {i for i, (_, c) in brute.components(own, 5, 80, 100).items() if i == c}
    assert {r.doc_id for r in one.collect()} == left and one.columns == columns

    clean = step["personal data"](spark, one, SF)
    assert clean.columns == columns
    for r in clean.collect():
        assert r.text == pii.redact(own[r.doc_id]) and r.n_chars == len(r.text)

    mixed = step["mixing to target weights"](spark, clean, SF)
    assert mixed.columns == columns
    before = {r.doc_id: r.text for r in clean.collect()}
    out = mixed.collect()
    words = {i: t.split() for i, t in before.items()}
    assert sum(len(r.text.split()) for r in out) == sum(map(len, words.values()))
    assert all(r.text.split() == words[r.doc_id][: len(r.text.split())] for r in out)

    packed = step["best-fit packing"](spark, mixed, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in out}


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 50 and out.groupBy("sequence_id").agg({"length": "sum"}).filter("`sum(length)` > 1024").count() == 0
