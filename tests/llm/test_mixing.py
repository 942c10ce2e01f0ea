"""Mixing against a plain recursive allocation."""

import random

from pyspark.sql import functions as F

from quillon.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, take string"


def docs(spark, n=400, seed=2):
    rng = random.Random(seed)
    rows = [(i, " ".join(["w"] * rng.randrange(40)), rng.choice(["en", "en", "de", "it", None]), f"src{min(rng.randrange(12), rng.randrange(12))}", 0, "x") for i in range(n)]
    return spark.createDataFrame([*rows, (n, None, "en", "src0", 0, ""), (n + 1, "a b", None, None, 0, ""), (n + 2, "a", "en", "odd", 0, "")], SCHEMA)


def filled(total, children):
    """children: name to (weight, cap); name to exact share."""
    out, open_, left = {}, dict(children), total
    while open_:
        w = sum(x for x, _ in open_.values())
        short = {k: c for k, (x, c) in open_.items() if c * w <= x * left}
        if not short:
            return out | {k: left * x / w for k, (x, _) in open_.items()}
        for k, c in short.items():
            out[k] = c
            del open_[k]
        left -= sum(short.values())
    return out


def test_budgets_follow_the_tree(spark):
    df = docs(spark)
    w = mixing.Weights(origin={"src1": 5})
    out = mixing.mix(df, share=1.2, epochs=2, weights=w).select("doc_id", *mixing.LEAF, "n_tokens", "epoch", F.col("take").cast("long").alias("take")).collect()
    words = {}
    for r in df.collect():
        digits = "".join(c for c in (r.source or "") if c.isdigit())
        leaf = (f"d{int(digits) % 4}" if digits else "none", r.lang or "none", r.source or "none")
        n = len((r.text or "").split())
        if n:
            words[leaf] = words.get(leaf, 0) + n
    supply = sum(words.values())

    def cap(prefix):
        return 2 * sum(n for k, n in words.items() if k[: len(prefix)] == prefix)

    def spread(prefix, total):
        if len(prefix) == 3:
            return {prefix: total}
        names = getattr(w, ("domain", "language", "origin")[len(prefix)])
        kids = {k[: len(prefix) + 1] for k in words if k[: len(prefix)] == prefix}
        got = filled(total, {k: (names.get(k[-1], w.other), cap(k)) for k in kids})
        return {leaf: b for k, t in got.items() for leaf, b in spread(k, t).items()}

    want = spread((), min(int(1.2 * supply), 2 * supply))
    have = {}
    for r in out:
        have[(r.domain, r.language, r.origin)] = have.get((r.domain, r.language, r.origin), 0) + r.take
    for leaf, b in want.items():
        assert abs(have.get(leaf, 0) - b) <= 3, leaf
    assert sum(have.values()) == int(1.2 * supply)
    for leaf in want:  # a cut document is the last of its epoch
        own = [r for r in out if (r.domain, r.language, r.origin) == leaf]
        assert sum(r.take < r.n_tokens for r in own) <= 1
        seen = [(r.doc_id, r.epoch) for r in own]
        assert len(seen) == len(set(seen))


def test_documents_keep_their_columns(spark):
    df = docs(spark)
    out = mixing.mixed_documents(df, share=0.5)
    assert out.columns == df.columns
    rows = out.collect()
    assert sum(len(r.text.split()) for r in rows) == int(0.5 * sum(len((r.text or "").split()) for r in df.collect()))
    assert all(r.n_chars == len(r.text) for r in rows)
    assert mixing.mixed_documents(df.limit(0)).count() == 0


def test_rows_that_equal_the_last_of_a_prefix(spark):
    rows = [(7, "a b c d", "en", "src0")] * 9 + [(None, "x y", "en", "src1")] * 5 + [(None, "x  z", "en", "src1")] * 4
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = mixing.mix(df, total=26, epochs=1, weights=mixing.Weights(domain={}, language={}))
    got = [(r.doc_id, r.take) for r in out.collect()]
    assert sum(t for _, t in got) == 26
    for i, n in ((7, 4), (None, 2)):
        own = sorted(t for d, t in got if d == i)
        assert sum(own) == 13 and sum(t < n for t in own) == 1
    assert sum(len(r.text.split()) for r in mixing.mixed_documents(df, total=26, epochs=1).collect()) == 26


def test_clashing_names_quotes_and_zero_weights(spark):
    rows = [(i, "w " * (i % 7 + 1), "it's" if i % 2 else "en", "src1", i, "w", "r", "f", 3) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, whole int, rest string, row string, cut string, Take int")
    out = mixing.mix(df, share=0.5, weights=mixing.Weights(language={"it's": 0, "en": 1})).collect()
    assert {r.language for r in out} == {"en"} and all(r.whole == r.doc_id and r.rest == "w" and r.row == "r" for r in out)
    assert sum(r.take for r in out) == sum(len(r[1].split()) for r in rows) // 2
    assert mixing.mixed_documents(df, share=0.5).columns == df.columns
    assert not mixing.mix(df, weights=mixing.Weights(language={"it's": 0, "en": 0})).count()


def test_very_long_text(spark):
    df = spark.createDataFrame([(1, "long word " * 300_000, "en", "src1"), (2, "a b", "en", "src1")], "doc_id long, text string, lang string, source string")
    assert sum(len(r.text.split()) for r in mixing.mixed_documents(df, total=500_001).collect()) == 500_001
