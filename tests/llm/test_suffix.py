"""A host's dealt suffix array: order and common prefixes, shared runs against a plain search, every page in the query."""

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quillon.llm import html_text as h
from quillon.llm import suffix as x


def test_suffix_array_is_sorted_by_tokens():
    rng = np.random.default_rng(3)
    ids = rng.integers(0, 3, 4000).astype(np.int32)
    for long in (4, 5, 8):
        start = np.arange(len(ids) - long + 1)
        group = rng.integers(0, 2, len(start))
        order, common = x.suffix_array(ids, start, group, long)
        own = [(int(group[k]), *ids[k : k + long].tolist()) for k in start[order]]
        assert own == sorted(own) and sorted(order.tolist()) == start.tolist()
        for a, b, n in zip(own, own[1:], common[1:].tolist(), strict=False):
            want = -1 if a[0] != b[0] else next((i for i in range(long) if a[1 + i] != b[1 + i]), long)
            assert n == want


def _plain(pages, long):
    """({page: shared places}, {page: places that go}) by comparing all runs of tokens."""
    pages_of, loose_of = defaultdict(set), defaultdict(set)

    def runs(streams):
        for at, kind, text in streams:
            t = text.split()
            if len(t) >= long:
                yield from ((at, kind, i, tuple(t[i : i + long]), long) for i in range(len(t) - long + 1))
            elif t and kind == x.NAMED:
                yield at, kind, 0, (*t, *[""] * (long - len(t))), len(t)

    for host, page, streams in pages:
        for _, kind, _, run, _ in runs(streams):
            pages_of[host, run].add(page)
            if kind != x.FIXED:
                loose_of[host, run].add(page)
    shared, gone = defaultdict(set), defaultdict(set)
    for host, page, streams in pages:
        for at, kind, i, run, n in runs(streams):
            if at >= 0 and len(pages_of[host, run]) > 1:
                shared[page].update(range(at + i, at + i + n))
            if at >= 0 and kind != x.FIXED and len(loose_of[host, run]) > 1:
                gone[page].update(range(at + i, at + i + n))
    return shared, gone


def _split(batches):
    """What is decided, and the blobs by bucket."""
    done, blobs = [], defaultdict(list)
    for b in batches:
        done += b.filter(pc.is_null(b.column("blob"))).to_pylist()
        for r in b.filter(pc.is_valid(b.column("blob"))).to_pylist():
            blobs[r["bucket"]].append(r["blob"])
    return done, blobs


def _batch(pages, prints=None):
    cols = {"host": pa.array([p[0] for p in pages], pa.int64()), "page": pa.array([p[1] for p in pages], pa.int64())}
    cols |= {c: pa.array([[s[k] for s in p[2]] for p in pages], pa.list_(pa.int32())) for k, c in enumerate(("at", "kind"))}
    cols |= {"packed": pa.array([x.pack_streams(p[2]) for p in pages], pa.binary())}
    if prints is not None:
        cols["prints"] = pa.array([sorted(prints[p[1]]) for p in pages], pa.list_(pa.int32()))
    return pa.RecordBatch.from_pydict(cols)


def test_shared_runs_equal_a_plain_search():
    rng = random.Random(6)
    for long, buckets, per_step in ((8, 5, 7), (8, 1, 1000), (5, 3, 1), (8, 2, 20)):
        shared_parts = [" ".join(rng.choice("abcd") for _ in range(rng.randrange(2, 20))) for _ in range(8)] + ["same " * 30]
        pages = []
        for page in range(120):
            streams, at = [], 0
            for kind in rng.choices((x.FIXED, x.LOOSE, x.NAMED), k=rng.randrange(0, 4)):
                text = " ".join(rng.choice(shared_parts) if rng.random() < 0.4 else f"u{rng.random()}" for _ in range(rng.randrange(1, 5)))
                aside = kind == x.LOOSE and rng.random() < 0.3
                streams.append((-1 if aside else at, kind, " ".join(text.split())))
                at += 0 if aside else len(text.split())
            pages.append((page % 3 - 1, page * 7919 - 400_000, streams))
        pages += pages[:10]  # equal rows are one page
        steps = [pages[i : i + per_step] for i in range(0, len(pages), per_step)]
        prints, blobs = defaultdict(set), defaultdict(list)
        for step in steps:
            found = [(k, np.asarray(b.column("page"))[row]) for b in [_batch(step)] for k, row, *_ in x.suffixes(b, long)]
            if found:
                done, some = _split(x.keys_of_step(*map(np.concatenate, zip(*found, strict=True)), buckets))
                for r in done:
                    prints[r["page"]].add(r["print"])
                for k, v in some.items():
                    blobs[k] += v
        for some in blobs.values():
            for page, key in zip(*x.keys_of_bucket(some), strict=True):
                prints[int(page)].add(int(key))
        rows, blobs = [], defaultdict(list)
        for step in steps:
            pieces = x.Pieces(long, buckets)
            pieces.add(_batch(step, prints))
            done, some = _split(pieces.blobs())
            rows += [(r["page"], r["at"], r["size"], r["gone"]) for r in done]
            for k, v in some.items():
                blobs[k] += v
        for some in blobs.values():
            rows += [tuple(r) for r in zip(*(c.tolist() for c in x.repeats(some, long)), strict=True)]
        shared, gone = defaultdict(set), defaultdict(set)
        for page, at, size, g in rows:
            for cover in (shared, gone) if g else (shared,):
                cover[page].update(range(at, at + size))
        want = _plain(pages, long)
        assert (shared, gone) == want and sum(map(len, want[1].values())) > 50


def test_suffixes_are_compared_by_tokens():
    """Pieces that hashes deal alike are told apart: a bucket holds suffixes of one key whose tokens differ."""
    texts = [" ".join(f"w{page}x{k}" for k in range(8)) + " " for page in range(4)] + [" ".join(f"w0x{k}" for k in range(8)) + " "]
    n = np.arange(5)
    blob = x.pack(np.zeros(5, np.int64), np.ones(5), np.full(5, 8), n, n + 100, n * 10, "".join(texts).encode())
    page, at, size, gone = x.repeats([blob], 8)
    assert sorted(zip(page.tolist(), at.tolist(), size.tolist(), gone.tolist(), strict=True)) == [(100, 0, 8, True), (104, 40, 8, True)]


def test_every_page_takes_part(spark):
    """Articles are in the host's array as well: shared runs are found in them, stay as reprints, and are counted on the row."""
    run = " ".join(f"r{k}" for k in range(12))
    data = [
        (1, "http://h.example/1", f"<article><p>own one</p><p>{run}</p></article>"),
        (2, "http://h.example/2", f"<article><p>{run}</p><p>own two</p></article>"),
        (3, "http://h.example/3", f"<article><p>{run} {run}</p></article>"),
        (4, "http://h.example/4", "<article><p>" + " ".join(f"r{k}" for k in range(7)) + "</p></article>"),
        (5, "http://other.example/5", f"<article><p>{run}</p></article>"),
        (6, "http://h.example/6", f"<p>no article but {run}</p>"),
        (7, "http://h.example/7", None),
        (8, "http://twice.example/8", f"<article><p>{run}</p></article>"),
        (8, "http://twice.example/8", f"<article><p>{run}</p></article>"),
    ]
    rows = h.extract(spark.createDataFrame(data, "page_id long, url string, html string")).collect()
    assert len(rows) == len(data)
    got = {r.page_id: (r.text, r.n_shared) for r in rows}
    short = " ".join(f"r{k}" for k in range(7))
    assert got == {1: (f"own one {run}", 12), 2: (f"{run} own two", 12), 3: (f"{run} {run}", 24), 4: (short, 0), 5: (run, 0), 6: (f"no article but {run}", 12), 7: ("", 0), 8: (run, 0)}
