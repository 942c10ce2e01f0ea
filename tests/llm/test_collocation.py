"""Collocations against plain counting."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

import brute
from quillon.llm import collocation as co

SCHEMA = "doc_id long, text string, lang string, n int, word string"


def plain(rows, least=10, top=2000):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", brute.ascii_lower(text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in (1, 2, 3):
                f[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        found = {g: a for g, a in c.items() if len(g) > 1 and a >= least}
        best = []
        for g, a in found.items():
            if any(len(x) > len(g) and 100 * b >= 50 * a and any(x[i : i + len(g)] == g for i in range(len(x))) for x, b in found.items()):
                continue
            s, _, left, right = min((10**6 * a * a // (c[g[:k]] * c[g[k:]]), k, c[g[:k]], c[g[k:]]) for k in range(1, len(g)))
            best.append((-s, -a, " ".join(g).encode(), left, right))
        out += [(lang, i, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(best)[:top], 1)]
    return sorted(out)


def texts(seed, n=120):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(12)] + ["É", "é", "ABC", "abc", "a.b", "x y", "\x00", "\x1c", "new york city", "rock\tand  roll"]
    out = []
    for i in range(n):
        t = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", ". ", ",", "\n", "\x0b", "  "]) for _ in range(rng.randrange(60)))
        out.append((i, t, rng.choice(["en", "fr", None])))
    return out + [(900, None, "en"), (901, "", None), (902, "a b " * 30_000, "de"), (None, "same same", "en"), (None, "same same", "en"), (903, "only once here", "nl")]


def run(spark, rows, **kw):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(3)
    return sorted(map(tuple, co.collocations(df, **kw).collect()))


@pytest.mark.parametrize("most", [co.DICTIONARY, 0])
def test_equals_plain_counting(spark, most):
    rows = texts(4)
    assert run(spark, rows, most=most) == plain(rows)


def test_small_top_and_ties(spark):
    rows = texts(5) + [(1000 + i, f"tie{i % 4} tie{i % 4}x", "tt") for i in range(48)]
    assert run(spark, rows, least=3, top=5) == plain(rows, 3, 5)


def test_small_steps_and_merges(spark, monkeypatch):
    monkeypatch.setattr(co, "SHARD_WORDS", 50)
    rows = texts(6)
    assert run(spark, rows) == plain(rows)


def test_empty(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None, None)]) == []


@pytest.mark.parametrize("b", [1, 2, 7, 21, 22, 33, 42])
@pytest.mark.parametrize("n", [2, 3])
def test_filters_are_lossless(b, n):
    rng = np.random.default_rng(b)
    ids = [rng.integers(0, 1 << b, 500) for _ in range(n)]
    ids = [np.concatenate([i, i[:200]]) for i in ids]
    field = co.Field(n, b)
    left, right = field.pack(ids)
    assert all((x == y).all() for x, y in zip(field.unpack(left, right), ids, strict=True))
    left, right, count = field.counted(left, right)
    count = count * rng.integers(1, 400, len(count))
    want = Counter()
    for *g, c in zip(*(i.tolist() for i in field.unpack(left, right)), count.tolist(), strict=True):
        want[tuple(g)] += c
    got = Counter()
    given = min(3, field.w)
    parts = []
    for s in range(1 << given):
        own = left >> np.uint64(field.w - given) == s
        parts.append(field.read(field.write(left[own], right[own], count[own], given), s, given))
    both = field.counted(*(np.concatenate([*x, *x]) for x in zip(*parts, strict=True)))
    for *g, c in zip(*(i.tolist() for i in field.unpack(*both[:2])), both[2].tolist(), strict=True):
        got[tuple(g)] += c
    assert got == Counter({g: 2 * c for g, c in want.items()}) and len(want) == len(left)


def test_products_beyond_64_bits(spark):
    df = spark.createDataFrame([(4_000_000_000_000_000, 4_100_000_000_000_000, 4_200_000_000_000_007)], "a long, l long, r long")
    got = df.select(co.score(df.a, df.l, df.r)).first()[0]
    assert got == 10**6 * 4_000_000_000_000_000**2 // (4_100_000_000_000_000 * 4_200_000_000_000_007)
