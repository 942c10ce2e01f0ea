"""Exact substring dedup by super-k-mers.

A window is a run of WIDTH consecutive words of one document; its minimiser is the smallest hash of its word triples. Consecutive windows that share a minimiser are one super-k-mer. It travels once, packed, to the minimiser's bucket, so equal windows of all documents meet there, where sorting finds them; equality is checked word by word (64-bit word hashes). The packed form is the super-k-mers' own text, compressed bucket by bucket.

Super-k-mers that are equal inside one map step are combined before the shuffle: only the earliest travels, the windows of the others are repeats already. So a passage that a third of all documents share reaches its bucket once a map step.

A minimiser that many contexts share would make its bucket grow with the corpus. Minimisers that are frequent in a sample of documents (those whose texts hash lowest) are heavy: their windows travel one by one, dealt by the window's own hash. The sample grows with the buckets, by PER_BUCKET documents each beyond SAMPLE, so that a minimiser with a quarter of a bucket's share of all super-k-mers is expected more than RARE times in it, however many buckets there are. All windows with one minimiser are treated alike, so the sample decides about the load alone and never about the result. A text of any length is read in pieces; what one map step holds is bounded but for the longest text.

Defined cases: null and empty texts have no words. Rows are ordered by doc_id (null last), rows with the same id by a 64-bit hash of their text, of which it is made sure that it tells them apart; rows equal in id and text are one document and get the same result. Documents shorter than a window keep everything. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm.common import _WS, CHUNK_BYTES, cut_lineage, map_arrow, map_batches, mix64, parallelism, powers, rolling, table, text_chunks, within, words

#: Words of a minimiser.
SEED = 3
#: Words that one map step combines and packs together.
STEP_WORDS = 2_000_000
#: Documents that heavy minimisers are sought in, and more of them for each bucket; occurrences there that are too few to count.
SAMPLE, PER_BUCKET, RARE = 2000, 10, 20
#: Draws of tags before texts of one id are given up.
TAGS = 8
#: Buckets for each shuffle partition; a reducer holds one bucket at a time.
BUCKETS = 4


def sliding_min(g: np.ndarray, n: int) -> np.ndarray:
    """Minimum of every n consecutive values, by doubling."""
    m, w = g, 1
    while 2 * w <= n:
        m = np.minimum(m[:-w], m[w:])
        w *= 2
    return np.minimum(m[: len(m) - (n - w)], m[n - w :]) if n > w else m


def spans_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of h[start:end]."""
    up, down = powers(len(h) + 1)
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[: len(h)], out=sums[1:])
    return mix64((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def super_kmers(h: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(minimiser, text, first word, windows) of each run of windows with one minimiser."""
    pos, doc = within(first, width)
    if not len(pos):
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, z
    low = sliding_min(rolling(h, SEED), width - SEED + 1)[pos]
    new = np.ones(len(pos), bool)
    new[1:] = (low[1:] != low[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return low[at], doc[at], pos[at], np.diff(np.append(at, len(pos)))


def expand(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[i], start[i] + 1, ... n[i] values each."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start, n)


def same_words(h: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray, maybe: np.ndarray, width: int) -> np.ndarray:
    """Of the super-k-mers at a and b with n and m windows, those of equal words, where maybe is set."""
    out = maybe & (n == m)
    at = np.flatnonzero(out)
    if len(at):
        size = n[at] + width - 1
        differ = h[expand(a[at], size)] != h[expand(b[at], size)]
        out[at] = ~np.logical_or.reduceat(differ, np.cumsum(size) - size)
    return out


class Blob:
    """Super-k-mers of one bucket: where they stand, and their text."""

    @staticmethod
    def pack(doc: np.ndarray, tag: np.ndarray, start: np.ndarray, n: np.ndarray, texts: list[bytes]) -> bytes:
        head = np.array([len(doc)], np.int64)
        raw = b"".join([*(x.tobytes() for x in (head, doc, tag, start.astype(np.int32), n.astype(np.int32))), b" ".join(texts)])
        return zstandard.ZstdCompressor(level=3).compress(raw)

    @staticmethod
    def unpack(blob: bytes) -> tuple[np.ndarray, ...]:
        """(doc, tag, start, windows, word hashes)."""
        raw = zstandard.ZstdDecompressor().decompress(blob)
        k, at, place = int(np.frombuffer(raw, np.int64, 1)[0]), 8, []
        for kind in (np.int64, np.int64, np.int32, np.int32):
            place.append(np.frombuffer(raw, kind, k, at))
            at += np.dtype(kind).itemsize * k
        hashes = []
        data = np.frombuffer(raw, np.uint8, len(raw) - at, at)
        step = CHUNK_BYTES
        while len(data):  # cut at white space
            end = step if len(data) > step else len(data)
            while end < len(data) and data[end] != 32:
                end += 1
            hashes.append(words(data[:end], np.array([0, end]))[0])
            data = data[end:]
        return (*place, np.concatenate(hashes))


def joined_runs(doc: np.ndarray, tag: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of windows with overlapping or touching ones of the same document joined."""
    order = np.lexsort((start, tag, doc))
    doc, tag, start, end = doc[order], tag[order], start[order], (start + n)[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]) | (start[1:] > end[:-1])
    at = np.flatnonzero(new)
    return doc[at], tag[at], start[at], np.maximum.reduceat(end, at) - start[at] if len(at) else end


def heavy_minimisers(docs: DataFrame, width: int, buckets: int) -> np.ndarray:
    """The minimisers that have more than a quarter of a bucket's share of the sample's super-k-mers and are no rarity there: 4 a bucket at most. The sample is a share of the range of hashes, so nothing is sorted for it."""
    keyed = docs.select("text", F.xxhash64("text").alias("key"))
    texts = keyed.agg(F.approx_count_distinct("key")).first()[0]
    if (share := (SAMPLE + PER_BUCKET * buckets) / max(1, texts)) < 1:
        keyed = keyed.filter(F.col("key") < int(share * 2**64) - 2**63)
    low = keyed.groupBy("key").agg(F.first("text").alias("text")).select("text")

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        found = []
        for _, _, data, off in text_chunks(b.column(0)):
            h, first, _, _ = words(data, off)
            found.append(super_kmers(h, first, width)[0])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], ["low"])

    counts = map_batches(low, run, "low long").groupBy("low").agg(F.count(F.lit(1)).alias("n"))
    total = Window.partitionBy()
    some = counts.withColumn("all_", F.sum("n").over(total)).filter(F.col("n") * 4 * buckets > F.col("all_")).filter(f"n > {RARE}")
    return np.sort(np.array([r.low for r in some.select("low").collect()], np.int64).view(np.uint64))


def _packed(docs: DataFrame, width: int, buckets: int) -> DataFrame:
    """(bucket, blob) of super-k-mers, and with a null blob (doc, tag, start, n) of runs that the map step found repeated."""
    schema = "bucket int, blob binary, doc long, tag long, start int, n int"
    arrow = pa.schema([("bucket", pa.int32()), ("blob", pa.binary()), ("doc", pa.int64()), ("tag", pa.int64()), ("start", pa.int32()), ("n", pa.int32())])

    heavy = docs.sparkSession.sparkContext.broadcast(heavy_minimisers(docs, width, buckets))

    def step(parts: list[tuple], doc: np.ndarray, tag: np.ndarray) -> Iterator[pa.RecordBatch]:
        """parts: (word hashes, words of each text, byte starts, byte ends, bytes) of consecutive chunks."""
        h, first = np.concatenate([p[0] for p in parts]), np.concatenate([[0], np.cumsum(np.concatenate([p[1] for p in parts]))])
        base = np.cumsum([0, *(len(p[4]) for p in parts)])
        byte_start, byte_end = (np.concatenate([p[i] + at for p, at in zip(parts, base, strict=False)]) for i in (2, 3))
        data = np.concatenate([p[4] for p in parts]).tobytes()
        low, row, start, n = super_kmers(h, first, width)
        if not len(low):
            return
        if len(heavy.value):
            many = np.isin(low, heavy.value)
            at = expand(start[many], n[many])
            one = [spans_hash(h, at, at + width), np.repeat(row[many], n[many]), at, np.ones(len(at), n.dtype)]
            low, row, start, n = (np.concatenate([x[~many], y]) for x, y in zip((low, row, start, n), one, strict=True))
        own_doc, own_tag, own_start = doc[row], tag[row], start - first[row]
        content = spans_hash(h, start, start + n + width - 1)
        order = np.lexsort((own_start, own_tag, own_doc, content))
        again = np.zeros(len(low), bool)
        again[order[1:]] = same_words(h, start[order[1:]], start[order[:-1]], n[order[1:]], n[order[:-1]], content[order[1:]] == content[order[:-1]], width)
        head = order[np.maximum.accumulate(np.where(again[order], 0, np.arange(len(order))))]
        rep = order[again[order] & ((own_doc[order] != own_doc[head]) | (own_tag[order] != own_tag[head]) | (own_start[order] != own_start[head]))]
        if len(rep):
            d, t, s, k = joined_runs(own_doc[rep], own_tag[rep], own_start[rep], n[rep])
            nothing = pa.nulls(len(d), pa.binary())
            bucket = (mix64(d.view(np.uint64)) % np.uint64(buckets)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(bucket), nothing, pa.array(d), pa.array(t), pa.array(s, pa.int32()), pa.array(k, pa.int32())], schema=arrow)
        keep = np.flatnonzero(~again)
        bucket = (mix64(low[keep]) % np.uint64(buckets)).astype(np.int32)
        keep, bucket = keep[o := np.argsort(bucket, kind="stable")], bucket[o]
        edge = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(keep))
        blobs = []
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            k = keep[a:b]
            cut = zip(byte_start[start[k]].tolist(), byte_end[start[k] + n[k] + width - 2].tolist(), strict=True)
            blobs.append(Blob.pack(own_doc[k], own_tag[k], own_start[k], n[k], [data[x:y] for x, y in cut]))
        for a in range(0, len(blobs), 64):
            some = blobs[a : a + 64]
            no = pa.nulls(len(some), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(bucket[edge[a : a + len(some)]]), pa.array(some, pa.binary()), *[pa.nulls(len(some), pa.int64())] * 2, no, no], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, docs_, tags, total = [], [], [], 0
        for b in batches:
            doc, tag = np.asarray(b.column(0)), np.asarray(b.column(1))
            for i, j, data, off in text_chunks(b.column(2)):
                h, first, start, end = words(data, off)
                parts.append((h, np.diff(first), start, end, data))
                docs_.append(doc[i:j])
                tags.append(tag[i:j])
                total += len(h)
                if total >= STEP_WORDS:
                    yield from step(parts, np.concatenate(docs_), np.concatenate(tags))
                    parts, docs_, tags, total = [], [], [], 0
        if parts:
            yield from step(parts, np.concatenate(docs_), np.concatenate(tags))

    return map_arrow(docs, run, schema)


def bucket_repeats(blobs: list[bytes], width: int) -> tuple[np.ndarray, ...]:
    """Runs of windows of one bucket that occur earlier, found by sorting window hashes and comparing the words of equal ones."""
    parts = [Blob.unpack(b) for b in blobs]
    doc, tag, start, n, h = (np.concatenate(x) for x in zip(*parts, strict=True))
    first = np.cumsum(n + width - 1) - (n + width - 1)  # each super-k-mer's first word in h
    at = expand(first, n)
    g = rolling(h, width)[at]
    order = np.argsort(g, kind="stable")
    same = g[order[1:]] == g[order[:-1]]
    hit = np.zeros(len(g), bool)
    hit[order[1:]] |= same
    hit[order[:-1]] |= same
    cand = np.flatnonzero(hit)
    if not len(cand):
        z = np.zeros(0, np.int64)
        return z, z, z, z
    kmer = np.searchsorted(np.cumsum(n), cand, "right")
    c_doc, c_tag, c_start = doc[kmer], tag[kmer], start[kmer] + cand - (np.cumsum(n) - n)[kmer]
    content = np.zeros(len(cand), np.int64)  # tells windows of one hash apart
    while True:
        o = np.lexsort((c_start, c_tag, c_doc, content, g[cand]))
        gs, cs = g[cand][o], content[o]
        head = np.append(True, (gs[1:] != gs[:-1]) | (cs[1:] != cs[:-1]))
        lead = np.maximum.accumulate(np.where(head, np.arange(len(o)), 0))  # the earliest of each hash
        equal = np.ones(len(o), bool)
        for i in range(width):
            equal &= h[at[cand[o]] + i] == h[at[cand[o[lead]]] + i]
        if equal.all():
            break
        odd = np.flatnonzero(np.isin(g[cand], gs[~equal]))
        content[odd] = np.unique(np.stack([h[at[cand[odd]] + i] for i in range(width)], 1), axis=0, return_inverse=True)[1].ravel()
    first_of = o[lead]
    rep = o[(c_doc[o] != c_doc[first_of]) | (c_tag[o] != c_tag[first_of]) | (c_start[o] != c_start[first_of])]  # not a repeated row of the same
    return joined_runs(c_doc[rep], c_tag[rep], c_start[rep].astype(np.int64), np.ones(len(rep), np.int64))


def repeated_runs(docs: DataFrame, width: int) -> DataFrame:
    """(doc, tag, start, n): windows start to start + n - 1 of the document occur earlier."""
    parts = parallelism(docs.sparkSession)
    packed = _packed(docs, width, parts * BUCKETS)
    names, kinds = ["doc", "tag", "start", "n"], [pa.int64(), pa.int64(), pa.int32(), pa.int32()]

    def out(cols: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, blobs = None, []
        for b in batches:
            done = b.filter(pa.compute.is_null(b.column(1)))
            if done.num_rows:
                yield pa.RecordBatch.from_arrays([done.column(c) for c in range(2, 6)], names)
            b = b.filter(pa.compute.is_valid(b.column(1)))
            for k, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if k != bucket and blobs:
                    yield out(bucket_repeats(blobs, width))
                    blobs = []
                bucket = k
                blobs.append(blob)
        if blobs:
            yield out(bucket_repeats(blobs, width))

    return map_arrow(packed.repartition(parts, "bucket").sortWithinPartitions("bucket"), run, "doc long, tag long, start int, n int")


def _uncovered(col: pa.Array, runs: pa.Array, width: int) -> Iterator[tuple[int, int, bytes]]:
    """(words, removed words, kept words joined by a space) of each text."""
    run_lists = runs.to_pylist()
    for i, j, data, off in text_chunks(col):
        _, first, start, end = words(data, off)
        cover = np.zeros(len(start) + 1, np.int32)
        for row in range(i, j):
            for r in run_lists[row] or ():
                a = first[row - i] + r["start"]
                cover[a] += 1
                cover[a + r["n"] + width - 1] -= 1
        kept = np.cumsum(cover[:-1]) == 0
        # a kept word stays with the byte behind it, which becomes the space
        mark = np.zeros(len(data) + 2, np.int8)
        mark[start[kept]] += 1
        mark[np.minimum(end + 1, np.repeat(off[1:], np.diff(first)))[kept]] -= 1  # no byte of the next text
        keep = np.cumsum(mark[:-2], dtype=np.int8) > 0
        text = np.where(_WS[data], np.uint8(32), data)
        removed = np.concatenate([[0], np.cumsum(~kept)])
        for row in range(j - i):
            a, b = off[row], off[row + 1]
            yield int(first[row + 1] - first[row]), int(removed[first[row + 1]] - removed[first[row]]), text[a:b][keep[a:b]].tobytes().rstrip(b" ")


def _tag(text: Column, unnamed: Column, seed: int) -> Column:
    """64 bits that tell texts of one id apart."""
    return F.xxhash64(text, unnamed, F.lit(seed))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, tag, text, doc_id): doc and tag are one row's, or those of rows equal in id and text. Where ids repeat or are null, texts that share a tag are looked for; if there are any, the tags are drawn anew."""
    id_, text = F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit(""))
    named = docs.select(F.coalesce(id_, F.lit((1 << 63) - 1)).alias("doc"), text.alias("text"), id_.alias("doc_id"))
    again = named.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count() > 0
    for seed in range(TAGS):
        keyed = named.select("doc", _tag(F.col("text"), F.col("doc_id").isNull(), seed).alias("tag"), "text", "doc_id")
        whole = F.md5(F.col("text").cast("binary"))
        if not again or not keyed.groupBy("doc", "tag").agg(F.min(whole).alias("low"), F.max(whole).alias("high")).filter("low <> high").limit(1).count():
            return keyed
    raise ValueError(f"{TAGS} draws of 64 bits don't tell the texts of an id apart")


def _with_runs(docs: DataFrame, width: int) -> DataFrame:
    runs = cut_lineage(repeated_runs(docs.select("doc", "tag", "text"), width).distinct(), "runs")
    runs = runs.groupBy("doc", "tag").agg(F.collect_list(F.struct("start", "n")).alias("runs"))  # no longer than the document
    return docs.join(runs.hint("merge"), ["doc", "tag"], "left")


def dedup(docs: DataFrame, width: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept) of every row."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        n, gone, kept = zip(*_uncovered(b.column(1), b.column(2), width), strict=True)
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array([k.decode() for k in kept], pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    joined = _with_runs(_keyed(docs, id_col, text_col), width).select("doc_id", "text", "runs")
    return map_batches(joined, run, "doc_id long, n_words long, n_removed long, kept string")


def digest(docs: DataFrame, width: int = 20) -> DataFrame:
    """dedup with the kept text as its SHA-256."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        n, gone, kept = zip(*_uncovered(b.column(1), b.column(2), width), strict=True)
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    joined = _with_runs(_keyed(docs, "doc_id", "text"), width).select("doc_id", "text", "runs")
    return map_batches(joined, run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def op8_super_kmer_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"))
