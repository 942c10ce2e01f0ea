"""The trie of conversation prefixes against a plain one."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from quillon.llm import prefix_trie as pt

SCHEMA = "conv_id long, turn long, role string, text string, depth int, c string"


def plain(rows):
    convs = defaultdict(list)
    for r in rows:
        if r[0] is not None:
            convs[r[0]].append((r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in convs.items()}
    made = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        made[c] = own.get(c - c % 100, [])[:h] + own[c][h:]
    nodes = defaultdict(list)
    for c, t in made.items():
        for d in range(len(t) + 1):
            nodes[tuple(t[:d])].append(c)
    children = defaultdict(list)
    for k in nodes:
        if k:
            children[k[:-1]].append(k)
    leaves, saved = {}, {}
    for k in sorted(nodes, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in children[k]) or 1
        saved[k] = (len(nodes[k]) - 1) * (len(k[-1][1]) if k else 0) + sum(saved[x] for x in children[k])
    out = []
    for k, m in nodes.items():
        ends = ",".join(map(str, sorted(c for c in m if len(made[c]) == len(k))))
        out.append((min(m), len(k), min(nodes[k[:-1]]) if k else None, len(m), len(children[k]), leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def conversations(seed, n=60, words=3):
    """Few distinct turns, so many prefixes are shared; ids in several hundreds, some of whose first ids are absent."""
    rng = random.Random(seed)
    ids = rng.sample(range(100), n // 2) + rng.sample(range(400, 460), n // 4) + rng.sample(range(701, 799), n // 4) + [0, -5, -100]
    rows = []
    for c in dict.fromkeys(ids):
        rows += [(c, t if rng.random() < 0.95 or t else None, rng.choice(["user", "assistant", None, ""]), rng.choice(["hé", "ho", "", None, "x" * 50][: words + 2])) for t in range(rng.randrange(1, 12))]
    rng.shuffle(rows)
    return rows


def run(spark, rows, **kw):
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in pt.trie(df, **kw).drop("k1", "k2", *pt.UP).collect()), key=str)


@pytest.mark.parametrize("seed,shard", [(1, None), (2, 6), (3, 0)])
def test_equals_plain_trie(spark, seed, shard):
    rows = conversations(seed)
    assert run(spark, rows, shard=shard) == plain(rows)


def test_a_long_conversation_and_a_group_of_copies(spark):
    rng = random.Random(9)
    long = [(900, t, "user", f"{rng.random()}") for t in range(2000)]
    copies = [(c, t, "user", f"same {t}") for c in range(1000, 1100) for t in range(9)]
    rows = long + copies + [(1200, None, None, "very long " * 20_000), (None, 1, "user", "of none")]
    assert run(spark, rows, shard=100) == plain(rows)


def test_empty(spark):
    assert run(spark, []) == []
    assert run(spark, [(None, 1, "user", "x")]) == []


@pytest.mark.parametrize("limit", [1, 10, 10_000])
def test_queue_spills(limit):
    rng = random.Random(limit)
    queue, held = pt.SpillingQueue(limit), []
    for i in range(3000):
        item = (rng.randrange(500), rng.randrange(3), i)
        queue.push(item)
        held.append(item)
        if rng.random() < 0.3:
            assert queue.first() == min(held)
            held.remove(queue.pop())
    out = []
    while queue.first() is not None:
        out.append(queue.pop())
    assert out == sorted(held)
