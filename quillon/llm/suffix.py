"""Suffix arrays of hosts, dealt by what suffixes begin with.

A host's suffix array holds the suffixes of all token streams of its pages in order; neighbours whose common prefix has at least `long` tokens and that lie on distinct pages are text which these pages share. For that an array needs no order beyond the first `long` tokens, and it falls into ranges that can be sorted apart: suffixes are dealt by their key, a hash of the host and of one token triple, that whose hash is smallest in their first `long` tokens. Suffixes that begin alike have one key and meet, whatever their pages, and no task holds a host. The key decides about the task alone: there, suffixes are sorted and compared by their tokens.

A suffix whose key no other page has shares no such prefix: it would stand alone in the array and is left out. So 32 bits of each page's keys travel first, and then only the text of suffixes whose keys another page has as well. Neighbouring suffixes of one stream mostly have one key and travel together, as the piece of text that holds their first `long` tokens.

Text that very many pages share doesn't gather in a task: keys and pieces that distinct pages of one map step have are decided there, and one or two of each travel on as evidence for other steps.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import map_arrow, mix64, parallelism, text_chunks, words
from quillon.llm.substring import expand, joined_runs, super_kmers

#: Kinds of streams: text that is kept whatever repeats it; text that goes where another page's loose text repeats it; the same, and a stream of fewer than `long` tokens is one suffix.
FIXED, LOOSE, NAMED = 0, 1, 2
#: Keys and pieces that one map step combines and packs.
STEP_KEYS, STEP_PIECES = 500_000, 250_000
#: Buckets of keys and of pieces for each shuffle partition; a reducer sorts one at a time.
KEY_BUCKETS, PIECE_BUCKETS = 2, 4

_RUNS = pa.schema([("bucket", pa.int32()), ("blob", pa.binary()), ("page", pa.int64()), ("at", pa.int32()), ("size", pa.int32()), ("gone", pa.bool_())])
_KEYS = pa.schema([("bucket", pa.int32()), ("blob", pa.binary()), ("page", pa.int64()), ("print", pa.int32())])


def pack_streams(streams: list[tuple[int, int, str]]) -> bytes:
    """Of the texts alone; they hold no line breaks."""
    return zstandard.ZstdCompressor(level=9).compress("\n".join(s[2] for s in streams).encode())


def unpack_streams(packed: bytes) -> list[str]:
    text = zstandard.ZstdDecompressor().decompress(packed).decode()
    return text.split("\n") if text else []


def suffixes(b: pa.RecordBatch, long: int) -> Iterator[tuple]:
    """Of each chunk of a batch (host, page, at, kind, packed): (key, row, stream's kind and place, piece's first token in the stream, tokens, byte start, byte end) of the pieces, and the bytes. Streams of a row come in order."""
    texts = [unpack_streams(p) for p in b.column("packed").to_pylist()]
    row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    at, kind = (np.array([x for r in b.column(c).to_pylist() for x in r], np.int64) for c in ("at", "kind"))
    host = np.asarray(b.column("host"))[row].view(np.uint64)
    for i, j, data, off in text_chunks(pa.array([s for t in texts for s in t], pa.large_string())):
        h, first, start, end = words(data, off)
        low, own, begin, n = super_kmers(h, first, long)
        size, few = n + long - 1, np.diff(first)
        short = np.flatnonzero((few > 0) & (few < long) & (kind[i:j] == NAMED))
        low, own = np.concatenate([low, h[first[short]]]), np.concatenate([own, short])
        begin, size = np.concatenate([begin, first[short]]), np.concatenate([size, few[short]])
        if len(own):
            yield mix64(low ^ mix64(host[i + own])), row[i + own], kind[i + own], at[i + own], begin - first[own], size, start[begin], end[begin + size - 1], data


def _bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    return ((key >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)


def _print(key: np.ndarray) -> np.ndarray:
    return key.astype(np.uint32).view(np.int32)


def _slices(bucket: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to) of sorted buckets."""
    to, edge = np.unique(bucket, return_index=True)
    yield from zip(to.tolist(), edge.tolist(), [*edge[1:].tolist(), len(bucket)], strict=True)


def _blob_row(schema: pa.Schema, bucket: int, blob: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([blob], pa.binary()), *(pa.nulls(1, f.type) for f in list(schema)[2:])], schema=schema)


def _done_rows(schema: pa.Schema, buckets: int, *cols: np.ndarray) -> pa.RecordBatch:
    """What is decided already, dealt by the page."""
    bucket = (mix64(cols[0].view(np.uint64)) % np.uint64(buckets)).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(bucket), pa.nulls(len(bucket), pa.binary()), *(pa.array(c, f.type) for c, f in zip(cols, list(schema)[2:], strict=True))], schema=schema)


def keys_of_step(key: np.ndarray, page: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Keys that distinct pages of the step have, and a blob a bucket of all keys with a page each."""
    order = np.lexsort((page, key))
    key, page = key[order], page[order]
    other = np.append(True, key[1:] != key[:-1])
    new = other | np.append(True, page[1:] != page[:-1])
    key, page, other = key[new], page[new], other[new]
    edge = np.flatnonzero(other)
    many = np.repeat(np.diff(np.append(edge, len(key))) > 1, np.diff(np.append(edge, len(key))))
    if many.any():
        yield _done_rows(_KEYS, buckets, page[many], _print(key[many]))
    key, page = key[edge], page[edge]
    bucket = _bucket(key, buckets)
    order = np.lexsort((page, bucket))
    prints, page = _print(key[order]), page[order]
    for to, a, z in _slices(bucket[order]):
        pages, n = np.unique(page[a:z], return_counts=True)
        raw = b"".join(x.tobytes() for x in (np.array([len(pages)], np.int64), pages, n.astype(np.int32), prints[a:z]))
        yield _blob_row(_KEYS, to, zstandard.ZstdCompressor(level=3).compress(raw))


def keys_of_bucket(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(page, print) of those that distinct pages have."""
    pages, prints = [], []
    for blob in blobs:
        raw = zstandard.ZstdDecompressor().decompress(blob)
        n = int(np.frombuffer(raw, np.int64, 1)[0])
        pages.append(np.repeat(np.frombuffer(raw, np.int64, n, 8), np.frombuffer(raw, np.int32, n, 8 + 8 * n)))
        prints.append(np.frombuffer(raw, np.int32, -1, 8 + 12 * n))
    page, prints = np.concatenate(pages), np.concatenate(prints)
    order = np.argsort(prints, kind="stable")
    page, prints = page[order], prints[order]
    edge = np.flatnonzero(np.append(True, prints[1:] != prints[:-1]))
    shared = np.minimum.reduceat(page, edge) != np.maximum.reduceat(page, edge)
    hit = np.repeat(shared, np.diff(np.append(edge, len(page))))
    return page[hit], prints[hit]


def _ends(piece: np.ndarray, page: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each piece, a place on its smallest page and one on its largest: they tell whether it stands on two."""
    order = np.lexsort((page, piece))
    edge = np.flatnonzero(np.append(True, np.diff(piece[order]) != 0))
    return order[edge], order[np.append(edge[1:], len(order)) - 1]


class Pieces:
    """Pieces of a map step: each text of a host and kind once, with its places."""

    def __init__(self, long: int, buckets: int):
        self.long, self.buckets = long, buckets
        self.clear()

    def clear(self) -> None:
        self.seen: dict[tuple[int, bool], dict[bytes, int]] = defaultdict(dict)
        self.texts: list[bytes] = []
        self.own: list[tuple[int, int, bool, int]] = []  # bucket, host, loose, tokens
        self.piece: list[int] = []
        self.page: list[np.ndarray] = []
        self.at: list[np.ndarray] = []

    def add(self, b: pa.RecordBatch) -> None:
        """Of a batch (host, page, at, kind, packed, prints): pieces whose keys are among the page's prints."""
        host, page, prints = np.asarray(b.column("host")), np.asarray(b.column("page")), b.column("prints").to_pylist()
        wanted = np.repeat(np.arange(len(prints)), [len(p) for p in prints]) << 32 | np.array([x for p in prints for x in p], np.int32).view(np.uint32).astype(np.int64)
        for key, row, kind, at, begin, size, start, end, data in suffixes(b, self.long):
            hit = np.isin(row << 32 | key.astype(np.uint32).astype(np.int64), wanted)
            key, row, kind, at, begin, size, start, end = (x[hit] for x in (key, row, kind, at, begin, size, start, end))
            raw = data.tobytes()
            cut = zip(start.tolist(), end.tolist(), size.tolist(), host[row].tolist(), (kind != FIXED).tolist(), _bucket(key, self.buckets).tolist(), strict=True)
            for a, z, k, own, loose, to in cut:
                text = raw[a:z] + b" " * (1 + max(self.long - k, 0))  # a short stream ends in empty tokens, which no other token equals
                piece = self.seen[own, loose].setdefault(text, len(self.texts))
                if piece == len(self.texts):
                    self.texts.append(text)
                    self.own.append((to, own, loose, max(k, self.long)))
                self.piece.append(piece)
            self.page.append(page[row])
            self.at.append(np.where(at < 0, -1, at + begin))

    def blobs(self) -> Iterator[pa.RecordBatch]:
        """Runs that distinct pages of the step share, and a blob a bucket of all pieces."""
        if self.texts:
            bucket, host, loose, size = (np.array(x, np.int64) for x in zip(*self.own, strict=True))
            piece, page, at = np.array(self.piece), np.concatenate(self.page), np.concatenate(self.at)
            first, last = _ends(piece, page)
            many = page[first] != page[last]
            done = np.flatnonzero(many[piece] & (at >= 0))
            if len(done):
                real = np.array([len(t.split()) for t in self.texts])
                run = joined_runs(page[done], loose[piece[done]], at[done], real[piece[done]])
                yield _done_rows(_RUNS, self.buckets, run[0], run[2], run[3], run[1] != 0)
            left = ~many[piece]
            left[first] = left[last] = True  # two pages: one may have a suffix of the piece elsewhere too
            at[many[piece]] = -1
            piece, page, at = piece[left], page[left], at[left]
            order, places = np.argsort(bucket, kind="stable"), np.argsort(bucket[piece], kind="stable")
            local = np.empty(len(order), np.int64)
            bounds = bucket[piece][places]
            for to, a, z in _slices(bucket[order]):
                p, o = order[a:z], places[np.searchsorted(bounds, to) : np.searchsorted(bounds, to, "right")]
                local[p] = np.arange(z - a)
                yield _blob_row(_RUNS, to, pack(host[p], loose[p], size[p], local[piece[o]], page[o], at[o], b"".join([self.texts[k] for k in p.tolist()])))
        self.clear()


def pack(host: np.ndarray, loose: np.ndarray, size: np.ndarray, piece: np.ndarray, page: np.ndarray, at: np.ndarray, text: bytes) -> bytes:
    """Pieces (host, loose, size) and their places (piece, page, at). Hosts and pages that follow each other are listed once."""
    out = []
    for x in (host, page):
        new = np.append(True, x[1:] != x[:-1])
        out += [x[new], new.astype(np.int8)]
    out += [loose.astype(np.int8), size.astype(np.int32), np.diff(piece, prepend=0).astype(np.int32), at.astype(np.int32)]
    head = np.array([len(host), len(page), len(out[0]), len(out[2])], np.int64)
    return zstandard.ZstdCompressor(level=6).compress(b"".join([x.tobytes() for x in (head, *out)] + [text]))


def unpack(blob: bytes) -> tuple:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    pieces, places, hosts, pages = np.frombuffer(raw, np.int64, 4).tolist()
    end, out = 32, []
    for kind, n in ((np.int64, hosts), (np.int8, pieces), (np.int64, pages), (np.int8, places), (np.int8, pieces), (np.int32, pieces), (np.int32, places), (np.int32, places)):
        out.append(np.frombuffer(raw, kind, n, end))
        end += n * np.dtype(kind).itemsize
    host, page = (out[k][np.cumsum(out[k + 1], dtype=np.int64) - 1] for k in (0, 2))
    return host, out[4] != 0, out[5].astype(np.int64), np.cumsum(out[6], dtype=np.int64), page, out[7], raw[end:]


def suffix_array(ids: np.ndarray, start: np.ndarray, group: np.ndarray, long: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, common) of the suffixes of ids at start: sorted by group and their first `long` tokens; common tokens of each with the one before, at most long, -1 where the group is another."""
    keys = [ids[start + i].astype(np.int64) << 32 | (ids[start + i + 1] if i + 1 < long else 0) for i in range(0, long, 2)]
    order = np.lexsort((*keys[::-1], group))
    common = np.full(len(order), -1, np.int32)
    same = group[order][1:] == group[order][:-1]
    common[1:][same] = 0
    for i in range(long):
        token = ids[start[order] + i]
        same = same & (token[1:] == token[:-1])
        common[1:] += same
    return order, common


def repeats(blobs: list[bytes], long: int) -> tuple[np.ndarray, ...]:
    """(page, at, size, gone) of runs of a bucket that lie in suffixes shared by distinct pages; gone: loose text that another page's loose text has as well."""
    parts = [unpack(b) for b in blobs]
    host, loose, size = (np.concatenate([p[i] for p in parts]) for i in range(3))
    base = np.cumsum([0, *(len(p[0]) for p in parts)])
    piece = np.concatenate([p[3] + b for p, b in zip(parts, base, strict=False)])
    page, at = (np.concatenate([p[i] for p in parts]) for i in (4, 5))
    data = np.frombuffer(b"".join([p[6] for p in parts]), np.uint8)
    token = np.concatenate([[0], np.flatnonzero(data == 32) + 1])
    col = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(token) - 1, [None, pa.py_buffer(token.astype(np.int64)), pa.py_buffer(data)])
    ids = np.asarray(col.dictionary_encode().indices)
    empty = token[1:] - token[:-1] == 1
    first, n = np.cumsum(size) - size, size - long + 1
    start, own = expand(first, n), np.repeat(np.arange(len(n)), n)

    low, high = (page[k] for k in _ends(piece, page))
    by_piece = np.argsort(piece, kind="stable")
    edge = np.searchsorted(piece[by_piece], np.arange(len(host)))
    order, common = suffix_array(ids, start, np.unique(host, return_inverse=True)[1][own], long)
    runs = np.flatnonzero(common < long)
    where = own[order]
    state = np.zeros(len(order), np.int8)
    most, least = np.iinfo(np.int64).max, np.iinfo(np.int64).min
    length = np.diff(np.append(runs, len(order)))
    shared = np.minimum.reduceat(low[where], runs) != np.maximum.reduceat(high[where], runs)
    gone = np.minimum.reduceat(np.where(loose[where], low[where], most), runs) < np.maximum.reduceat(np.where(loose[where], high[where], least), runs)
    state[order] = np.repeat(shared, length).astype(np.int8) + (np.repeat(gone, length) & loose[where])

    # runs of suffixes of one piece and one state, at each place of the piece
    new = np.append(True, (own[1:] != own[:-1]) | (state[1:] != state[:-1]))
    begin = np.flatnonzero(new)
    length = np.diff(np.append(begin, len(state)))
    hit = state[begin] > 0
    begin, length = begin[hit], length[hit]
    real = size - np.add.reduceat(empty, first)
    k = own[begin]
    offset = start[begin] - first[k]
    extent = np.minimum(length + long - 1, real[k] - offset)
    count = np.diff(np.append(edge, len(piece)))[k]
    place, run = by_piece[expand(edge[k], count)], np.repeat(np.arange(len(k)), count)
    seen = at[place] >= 0
    place, run = place[seen], run[seen]
    page, gone, at, extent = joined_runs(page[place], state[begin][run] == 2, at[place] + offset[run], extent[run])
    return page, at, extent, gone


def _by_bucket(dealt: DataFrame, decide, schema: pa.Schema) -> DataFrame:
    """Rows that are decided already, and what decide(blobs) gives of each bucket."""
    names, kinds = schema.names[2:], [f.type for f in list(schema)[2:]]

    def out(blobs: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(decide(blobs), kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, blobs = None, []
        for b in batches:
            done = b.filter(pa.compute.is_null(b.column(1)))
            if done.num_rows:
                yield pa.RecordBatch.from_arrays(done.columns[2:], names)
            b = b.filter(pa.compute.is_valid(b.column(1)))
            for k, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if k != bucket and blobs:
                    yield out(blobs)
                    blobs = []
                bucket = k
                blobs.append(blob)
        if blobs:
            yield out(blobs)

    parts = parallelism(dealt.sparkSession)
    return map_arrow(dealt.repartition(parts, "bucket").sortWithinPartitions("bucket"), run, ", ".join(f"{n} {_SQL[k]}" for n, k in zip(names, kinds, strict=True)))


_SQL = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary", pa.bool_(): "boolean"}


def shared_runs(pages: DataFrame, long: int) -> DataFrame:
    """(page, at, size, gone) of pages (host, page, at, kind, packed, more), whose streams have a kind and begin at a place of the page's text (-1: they are evidence alone): runs of tokens that distinct pages of a host share; gone where both are loose. Steps take all columns, so that a shuffle which pages end in is made once."""
    key_buckets, piece_buckets = (parallelism(pages.sparkSession) * n for n in (KEY_BUCKETS, PIECE_BUCKETS))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, page, n = [], [], 0
        for b in batches:
            for k, row, *_ in suffixes(b, long):
                key.append(k)
                page.append(np.asarray(b.column("page"))[row])
                n += len(k)
            if n >= STEP_KEYS:
                yield from keys_of_step(np.concatenate(key), np.concatenate(page), key_buckets)
                key, page, n = [], [], 0
        if n:
            yield from keys_of_step(np.concatenate(key), np.concatenate(page), key_buckets)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = Pieces(long, piece_buckets)
        for b in batches:
            step.add(b.filter(pa.compute.is_valid(b.column("prints"))))
            if len(step.piece) >= STEP_PIECES:
                yield from step.blobs()
        yield from step.blobs()

    wanted = _by_bucket(map_arrow(pages, keys, "bucket int, blob binary, page long, print int"), keys_of_bucket, _KEYS)
    wanted = wanted.groupBy("page").agg(F.collect_set("print").alias("prints"))  # no more than the page's tokens
    dealt = map_arrow(pages.join(wanted.hint("merge"), "page", "left"), pieces, "bucket int, blob binary, page long, at int, size int, gone boolean")
    return _by_bucket(dealt, lambda blobs: repeats(blobs, long), _RUNS)
