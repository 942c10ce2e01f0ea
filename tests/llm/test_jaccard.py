"""Jaccard join against all pairs."""

import random

import brute
import pytest

from quillon.llm import jaccard

SCHEMA = "doc_id long, text string, cls long, low string"


def run(spark, texts, k, num):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in texts.items()], SCHEMA)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.components(df, k, num, 100).collect()}


def near_copies(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    texts, i = {}, 0
    for n in (1, 2, 3, 5, 9, 12, 30, 31, 80, 150):
        base = [rng.choice(words) for _ in range(n)]
        for edits in (0, 0, 1, 1, 1, 2, 3, 5):
            own = list(base)
            for _ in range(edits):
                own[rng.randrange(n)] = rng.choice(words)
            texts[i] = " ".join(own)
            i += 1
    return texts | {i: None, i + 1: "", i + 2: " \n\t", i + 3: "A b", i + 4: "a B"}


@pytest.mark.parametrize(("k", "num"), [(3, 90), (5, 80), (1, 50)])
def test_equals_all_pairs(spark, k, num):
    texts = near_copies(k)
    assert run(spark, texts, k, num) == brute.components(texts, k, num, 100)


def test_empty_table_and_repeated_rows(spark):
    assert run(spark, {}, 3, 90) == {}
    df = spark.createDataFrame([(4, "a b c d", 1, ""), (4, "a b c d", 1, ""), (None, "a b c d", 1, ""), (9, None, 1, "")], SCHEMA)
    rows = sorted((r.doc_id is None, r.doc_id, r.component_id) for r in jaccard.components(df, 3, 90, 100).collect())
    assert rows == [(False, 4, 4), (False, 4, 4), (False, 9, 9), (True, None, 4)]


def test_cell_of_texts_that_are_not_linked(spark):
    """Many texts that share much, none linked: every pass of pivots is needed."""
    rng = random.Random(3)
    base = [f"b{i}" for i in range(100)]
    texts = {}
    for i in range(60):
        own = list(base)
        for j in rng.sample(range(100), 4):
            own[j] = f"x{i}_{j}"
        texts[i] = " ".join(own)
    assert run(spark, texts, 3, 90) == brute.components(texts, 3, 90, 100)


def test_keep_one(spark):
    texts = near_copies(8)
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in texts.items()], SCHEMA)
    want = sorted(i for i, (_, c) in brute.components(texts, 5, 80, 100).items() if c == i)
    out = jaccard.keep_one(df)
    assert sorted(r.doc_id for r in out.collect()) == want and out.columns == df.columns


def test_text_without_id_links_others(spark):
    """The text between two others is held by rows without an id only, one with an id of another text too."""
    base = [f"w{i}" for i in range(40)]
    a, bridge, c = " ".join(base), " ".join(base[2:] + ["x1", "x2"]), " ".join(base[4:] + ["x1", "x2", "x3", "x4"])
    both = run(spark, {1: a, 2: c}, 3, 85)
    assert both[1][1] == 1 and both[2][1] == 2
    df = spark.createDataFrame([(1, a, 1, ""), (None, bridge, 1, ""), (None, bridge, 1, ""), (2, c, 1, ""), (None, "else", 1, "")], SCHEMA)
    rows = sorted((r.doc_id is None, r.doc_id or 0, r.component_id or 0) for r in jaccard.components(df, 3, 85, 100).collect())
    assert rows == [(False, 1, 1), (False, 2, 1), (True, 0, 0), (True, 0, 1), (True, 0, 1)]


def test_keep_one_of_repeated_ids(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    near = a.rsplit(" ", 1)[0] + " other"
    rows = [(1, a, 1, "x"), (1, a, 2, "y"), (2, a, 1, "x"), (2, b, 1, "x"), (3, c, 1, "x"), (3, c, 1, "x"), (1, near, 1, "x"), (5, "", 1, "x"), (5, "", 1, "x"), (None, a, 1, "x"), (6, b, 1, "x")]
    out = [(r.doc_id, r.text) for r in jaccard.keep_one(spark.createDataFrame(rows, SCHEMA)).collect()]
    groups = [{a, near}, {b}, {c}]
    assert [sorted(i for i, t in out if i is not None and t in g) for g in groups] == [[1], [2], [3]]
    assert sorted((i or 0, t) for i, t in out if i is None or not t) == [(0, a), (5, ""), (5, "")]
