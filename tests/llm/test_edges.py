"""Very long texts, empty tables and clashing columns of operators whose own tests hold short ones."""

import random

import brute
import public_tokenizers
import sentencepiece

from quillon.llm import edit_sketch, jaccard, media, substring, token_count

SCHEMA = "doc_id long, text string, cls string, row string, fingerprint string, bucket string, doc string, tag string"


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, *["x"] * 6) for i, t in texts.items()], SCHEMA)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for got in (jaccard.components(docs, 3, 90, 100), media.digest(docs), edit_sketch.compare_with_next(docs), substring.digest(docs)):
        assert "doc_id" in got.columns and got.count() == 0


def test_a_join_of_very_long_texts(spark):
    rng = random.Random(4)
    long = [f"w{rng.randrange(50_000)}" for _ in range(120_000)]
    near, far = long.copy(), long.copy()
    for i in rng.sample(range(len(long)), 1000):
        near[i] = "changed"
    for i in rng.sample(range(len(long)), 5000):
        far[i] = "other"
    texts = {1: " ".join(long), 2: " ".join(near), 3: " ".join(far), 4: "short text of five words", 5: None, 6: " ".join(long[:60_000])}
    want = brute.components(texts, 3, 90, 100)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.components(docs_of(spark, texts), 3, 90, 100).collect()}
    assert got == want
    assert got[2][1] == 1 and got[3][1] == 3 and got[6][1] == 6


def test_tokens_of_very_long_texts(spark):
    rng = random.Random(6)
    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = {
        1: " ".join(rng.choice(["language", "models", "count", "ééé", "第一"]) + str(rng.randrange(99)) for _ in range(60_000)),
        2: "".join(rng.choice("abcdefgh") for _ in range(30_000)),  # one word
        3: "a" * 20_000, 4: "  " * 5000 + "x", 5: "\n\t" * 3000,
    }
    got = {r.doc_id: r.n_tokens for r in token_count.token_counts(docs_of(spark, texts), path, 4096).collect()}
    assert got == {i: len(library.encode(t)) for i, t in texts.items()}
