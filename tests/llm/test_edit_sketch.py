"""Edit embedding against a walk in plain Python, and the next document against a sort."""

import hashlib
import random

import numpy as np
import pytest

from quillon.llm import edit_sketch as e


def plain(text):
    """The walk step by step."""
    bits, n = e._bits(), len(text)
    steps = e.sample_steps(np.array([max(2 * n, 1)]))[0]
    at, where = 0, []
    for j in range(int(steps.max()) + 1):
        where.append(at)
        c = ord(text[at]) if at < n else 0
        at = min(at + int(bits[j % e.ROWS][(c ^ c >> 8 ^ c >> 16) & 255]), n)
    m = (1 << 32) - 1
    out = []
    for s in steps:
        x = [ord(text[where[s] + i]) * 2654435761 & m if where[s] + i < n else 0 for i in range(4)]
        g = x[0]
        for i, k in enumerate((40503, 2246822519, 3266489917), 1):
            g = g + (x[i] ^ x[i] >> 15) * k & m
        out.append((g ^ g >> 13) * 668265263 % (m + 1) >> 24)
    return out


def words(rng, n):
    return " ".join("".join(rng.choice("abcdéöß日") for _ in range(rng.randrange(1, 9))) for _ in range(n))


def test_embedding_equals_the_plain_walk():
    rng = random.Random(1)
    texts = ["", "a", "🎉é", *(words(rng, rng.randrange(200)) for _ in range(20))]
    assert [list(x) for x in e.embed(texts)] == [plain(t) for t in texts]


def test_likeness_falls_with_edits():
    rng = random.Random(2)
    base = words(rng, 400)
    some = list(base)
    for _ in range(3):
        some[rng.randrange(len(some))] = "z"
    a, b, c = e.fingerprints([base, "".join(some), words(rng, 400)])
    assert (a == b).mean() > 0.5 > (a == c).mean()


def test_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = {r.doc_id: r for r in e.compare_with_next(docs).collect()}
    own = sorted(docs.collect(), key=lambda r: -r.doc_id)
    assert len(rows) == len(own)
    for r, after in zip(own, own[1:] + own[:1], strict=True):
        cut = len(r.text) // 3
        edited = r.text[: len(r.text) - cut] + after.text[:cut]
        got = rows[r.doc_id]
        f, g, n = e.fingerprints([r.text, edited, after.text])
        assert got.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got.n_chars == len(r.text)
        assert (got.fingerprint, got.edited_fingerprint) == (f.tobytes().hex(), g.tobytes().hex())
        assert abs(got.near_edited - (f == g).mean()) < 1e-9 and abs(got.near_next - (f == n).mean()) < 1e-9
    assert np.mean([r.near_edited > r.near_next for r in rows.values()]) > 0.9


def test_odd_rows(spark):
    schema = "doc_id long, text string, part string, key int"
    rows = [(1, None, "", 0), (2, "", "", 0), (2, "", "", 0), (3, "x" * 50_000, "", 0), (None, "abcdef", "", 0)]
    out = e.compare_with_next(spark.createDataFrame(rows, schema)).collect()
    assert len(out) == len(rows)
    last = next(r for r in out if r.doc_id is None)
    assert last.edited_sha256 == hashlib.sha256(b"abcdxx").hexdigest()
    assert e.compare_with_next(spark.createDataFrame([], schema)).count() == 0
    one = e.compare_with_next(spark.createDataFrame([(7, "abc", "", 0)], schema)).collect()
    assert one[0].edited_sha256 == hashlib.sha256(b"aba").hexdigest() and one[0].near_next == 1


def test_near_pairs(spark):
    rng = random.Random(5)
    texts = [words(rng, 300) for _ in range(6)]
    texts += [t[: -len(t) // 10] + words(rng, 30) for t in texts[:3]] + [texts[0]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    prints = {r.doc_id: r.fingerprint for r in e.sketch(df).collect()}
    got = {frozenset((r.fingerprint, r.near)) for r in e.near_pairs(df, 0.7).collect()}
    assert prints[0] == prints[9]
    assert got == {frozenset((prints[i], prints[i + 6])) for i in range(3)}


@pytest.mark.parametrize(("threshold", "block"), [(0.8, 1000), (0.8, 20), (0.7, 20), (0.3, 20)])
def test_near_pairs_of_large_groups(spark, monkeypatch, threshold, block):
    """All pairs that share a band: groups of near copies, of texts alike in one band only, and pairs between."""
    rng = np.random.default_rng(9)
    prints = rng.integers(0, 256, (240, e.SLOTS), dtype=np.uint8)
    prints[:200, :4] = 7  # one band's group
    prints[:60, 4:] = prints[0, 4:]
    for row in prints[1:60]:
        row[rng.choice(np.arange(4, e.SLOTS), rng.integers(1, 20), replace=False)] = rng.integers(0, 256)
    for i in range(60, 120, 2):
        prints[i + 1] = prints[i]
        prints[i + 1, rng.choice(e.SLOTS, rng.integers(1, 20), replace=False)] += 1
    prints = np.unique(prints, axis=0)
    rows = [(i, p.tobytes().hex()) for i, p in enumerate(prints)]
    monkeypatch.setattr(e, "sketch", lambda docs: docs)
    monkeypatch.setattr(e, "BLOCK", block)
    got = [(r.fingerprint, r.near, r.likeness) for r in e.near_pairs(spark.createDataFrame(rows, "doc_id long, fingerprint string"), threshold).collect()]
    same = prints[:, None] == prints[None]
    band = same.reshape(len(prints), len(prints), e.BANDS, -1).all(-1).any(-1)
    want = {(rows[i][1], rows[j][1], same[i, j].mean()) for i in range(len(prints)) for j in range(i) if band[i, j] and same[i, j].mean() >= threshold}
    assert len(want) > 300 and set(got) == want and len(got) == len(want)


def test_near_groups_and_their_recall(spark):
    """Groups are the components of pairs that share two bands; bands miss few of all pairs at the threshold."""
    rng = np.random.default_rng(3)
    prints = rng.integers(0, 256, (400, e.SLOTS), dtype=np.uint8)
    for i in range(0, 300, 3):  # chains of three
        for k in (1, 2):
            prints[i + k] = prints[i + k - 1]
            at = rng.choice(e.SLOTS, rng.integers(0, 18), replace=False)
            prints[i + k, at] = rng.integers(0, 256, len(at))
    prints[300:360] = prints[300]
    for row in prints[300:360]:
        row[rng.choice(e.SLOTS, 9, replace=False)] += 1
    rows = [(1000 - i, p.tobytes().hex()) for i, p in enumerate(prints)]
    same = prints[:, None] == prints[None]
    alike = same.mean(-1) >= 0.8
    bands = same.reshape(400, 400, e.BANDS, -1).all(-1)
    band = np.any([bands[..., i] & bands[..., j] for i, j in e.BAND_PAIRS], 0)
    assert (alike & band).sum() / alike.sum() > 0.95
    root = list(range(400))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in zip(*np.nonzero(alike & band), strict=True):
        root[find(i)] = find(j)
    low = {}
    for i in range(400):
        low[find(i)] = min(low.get(find(i), 2000), 1000 - i)
    want = {rows[i][1]: low[find(i)] for i in range(400)}
    got = {r.fingerprint: r.near_id for r in e.near_groups(spark.createDataFrame([*rows, (5000, rows[0][1])], "doc_id long, fingerprint string")).collect()}
    assert got == want
    assert e.near_groups(spark.createDataFrame([], "doc_id long, fingerprint string")).count() == 0


def test_rows_without_an_id_are_dealt_and_lent_once(spark):
    rows = [(None, f"text {i} of none") for i in range(3000)] + [(5, f"text {i} of five") for i in range(500)] + [(i, f"t{i}") for i in range(10, 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = e._in_order(df).collect()
    parts = {p for p, *_ in got}
    own = [(r.part, r.doc_id, r.text) for r in got if not r.lent]
    assert len(own) == len(rows) and sum(r.lent for r in got) == len(parts)
    sizes = [sum(p == q for q, *_ in own) for p in parts]
    assert len(parts) > 2 and max(sizes) < len(rows) / len(parts) * 2
    for r in got:  # a part's lent row is the first of the next part below
        if r.lent:
            below = max((p for p in parts if p < r.part), default=max(parts))
            assert (r.doc_id, r.text) in [(d, t) for p, d, t in own if p == below]


def test_places_among_cuts_of_one_key():
    keys, hashes = np.array([3, 5, 5, 5, 9]), np.array([0, -4, 0, 7, 1])
    for key, hash_, want in ((2, 0, 0), (3, 0, 0), (3, 1, 1), (5, -9, 1), (5, -4, 1), (5, 1, 3), (5, 8, 4), (6, 0, 4), (9, 1, 4), (9, 2, 5)):
        assert e._before(keys, hashes, np.array([key, key]), np.array([hash_, hash_])).tolist() == [want, want]
