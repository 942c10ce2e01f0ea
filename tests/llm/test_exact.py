"""Exact dedup against a dictionary of texts."""

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quillon.llm import exact

SCHEMA = "doc_id long, text string, h int, own string, m map<string,int>"


def table(spark, rows):
    return spark.createDataFrame([(i, t, 7, "x", {"a": 1}) for i, t in rows], SCHEMA).repartition(3)


def cases():
    rng = random.Random(5)
    texts = ["", " ", "a", "A", "a ", "é", "é", "long " * 50_000] + [f"text {i}" for i in range(20)]
    rows = [(i, rng.choice(texts)) for i in range(150)] + [(i, "hot") for i in range(150, 260)]
    rng.shuffle(rows)
    return rows + [(500, None), (501, ""), (None, "a"), (None, None), (None, "none"), (None, "none"), (7000, "twice"), (7000, "twice"), (7000, "else")]


def plain(rows, keep):
    by = defaultdict(list)
    for i, t in rows:
        by[t or ""].append(i)
    out = []
    for t, ids in by.items():
        order = sorted(ids, key=lambda i: (i is not None, i or 0), reverse=keep == "largest")
        out += [(i, order[0], len(ids), k == 0, hashlib.sha256(t.encode()).hexdigest()) for k, i in enumerate(order)]
    return sorted(out, key=str)


def weak(text):
    """A hash of 16 values: most groups hold different texts."""
    return F.substring(F.md5(text.cast("binary")), 1, 1).cast("binary")


@pytest.mark.parametrize("keep", ["largest", "smallest"])
@pytest.mark.parametrize("hash_", [exact.content_hash, weak])
@pytest.mark.parametrize("most", [exact.BROADCAST_HASHES, 0])
def test_equals_plain_grouping(spark, keep, hash_, most):
    rows = cases()
    got = exact.duplicates(table(spark, rows), keep, hash_=hash_, most=most)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows, keep)


@pytest.mark.parametrize("hash_", [exact.content_hash, weak])
def test_rows_that_stay_keep_their_columns(spark, hash_):
    rows = cases()
    got = exact.distinct_documents(table(spark, rows), hash_=hash_)
    assert got.columns == ["doc_id", "text", "h", "own", "m"]
    want = sorted(((i, s) for i, _, _, kept, s in plain(rows, "smallest") if kept), key=str)
    assert sorted(((r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in got.collect()), key=str) == want


def test_empty_table_and_wrong_rule(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert exact.duplicates(none).count() == 0 and exact.distinct_documents(none).count() == 0
    with pytest.raises(ValueError):
        exact.duplicates(none, "first")


def test_many_rows_of_one_id_and_text(spark, monkeypatch):
    monkeypatch.setattr(exact, "BLOCK", 7)
    rows = [(1, "same")] * 50 + [(2, "same")]
    assert sorted(map(tuple, exact.duplicates(table(spark, rows), "largest").select("doc_id", "group_size", "kept").collect())) == sorted([(1, 51, False)] * 50 + [(2, 51, True)])


def test_no_python_and_texts_only_where_hashes_repeat(spark):
    plan = exact.duplicates(table(spark, cases()))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
