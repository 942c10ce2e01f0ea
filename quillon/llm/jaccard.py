"""Exact n-gram Jaccard join in metric space.

Jaccard distance is a metric, and so is 1 - min/max on set sizes, which never exceeds it. The join works in three levels, each exact:

1. Size pivots. A ladder of sizes are the pivots of Voronoi regions on the size axis; a text goes to the region of its own size and, if the triangle-inequality window reaches over the border, to the one below as well.
2. Cells. Linked texts of one region differ in at most D shingles. The shingle universe is dealt into more than D parts, so two linked texts agree on all of some part that isn't empty: texts that share no projection with any other text are done, and only hashes have been shuffled. Those left meet in shingle cells: all their shingles have one order, rare ones first, and two linked texts share a shingle among the first few of either, as many as its smallest partner there allows it to miss, plus one. A shingle's place bounds the overlap that a pair can still reach, which leaves a window around each text.
3. Pivot documents. In each cell the text with most neighbours is the pivot. Texts within the radius are linked to it; the others can only be linked to texts whose distance from that pivot differs by no more than the radius (triangle inequality), and what is left of the cell joins again with more pivots, until it is known to be one component or has no pair left to try.

Plain Voronoi regions around sampled documents, without levels 1 and 2, don't part such texts: unrelated texts all lie at a distance near 1 from every pivot, so the windows copy nearly every text to every region.

The order comes from counts of all shingles in a table of ORDER_CELLS cells, whatever the input's size; cells that two shingles share only make the order less sharp.

Copies (equal sets) are one class from the start. Shingles and sets are told apart by 64-bit hashes. Distances between candidates are exact set intersections.

Defined cases: null and empty texts have no shingles and are linked with nothing. Repeated rows are copies of each other and each gets its row. Rows without an id take part; their component's id is the smallest that is not null, or null. A text of any length is read whole; its shingles are held by one task. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil, exp, sqrt

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm import regions
from quillon.llm.common import Scratch, cut_lineage, remove, map_arrow, map_batches, mix64, parallelism, rolling, table, text_chunks, within, words

#: Sizes of neighbouring regions, at least: a window then never reaches beyond the next region.
LADDER = 1.4
#: Projections that one map step combines.
STEP_ROWS = 300_000
#: Cells of the table of counts that shingles are ordered by.
ORDER_CELLS = 1 << 20


def shingle_sets(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes text by text, first of each text and the end). Fewer than k words: the whole sequence is one shingle."""
    pos, doc = within(first, k)
    g = rolling(h, k)[pos] if len(pos) else np.zeros(0, np.uint64)
    count = np.diff(first)
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        s = np.zeros(len(short), np.uint64)
        for i in range(k - 1):
            at = np.minimum(first[short] + i, len(h) - 1)
            s = np.where(i < count[short], s * np.uint64(0x9FB21C651E98DF25) + h[at], s)
        g, doc = np.concatenate([g, mix64(s + count[short].astype(np.uint64))]), np.concatenate([doc, short])
    order = np.lexsort((g, doc))
    g, doc = g[order], doc[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
    g, doc = g[new], doc[new]
    return g, np.searchsorted(doc, np.arange(len(first)))


def region_ladder(top: int, num: int, den: int) -> list[tuple[int, int, int]]:
    """(first size, parts, empty parts that are left out) of each region that sizes up to top need."""
    out, a = [], 1
    while a <= top:
        b = max(a + 1, ceil(a * max(LADDER, 1.02 * den / num)))  # sizes a to b - 1
        differ = (b - 1) * (den - num) // num
        m = differ + 1
        spare = 0
        if differ:
            for _ in range(8):
                mean = (m + spare) * exp(-a / (m + spare))
                spare = ceil(mean + 3 * sqrt(mean)) + 1
        out.append((a, m + spare, spare))
        a = b
    return out


def signatures(g: np.ndarray, at: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(projection hashes, text of each) for all regions of each text."""
    size = np.diff(at)
    if not len(g):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    ladder = region_ladder(int(size.max()), num, den)
    starts = np.array([a for a, _, _ in ladder])
    own = np.searchsorted(starts, size, "right") - 1
    sigs, docs = [], []
    for level in np.unique(own[size > 0]).tolist():
        here = np.flatnonzero((own == level) & (size > 0))
        over = here[-(-size[here] * num // den) < starts[level]] if level else here[:0]
        for lv, texts in ((level, here), (level - 1, over)):
            if not len(texts):
                continue
            _, m, spare = ladder[lv]
            n = size[texts]
            slot = np.repeat(np.arange(len(texts)), n)
            idx = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(at[texts], n)
            x = mix64(g[idx] ^ np.uint64((lv + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
            cell = slot * m + ((x >> np.uint64(20)) % np.uint64(m)).astype(np.int64)
            order = np.argsort(cell, kind="stable")
            cell, x = cell[order], x[order]
            edge = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
            total = np.add.reduceat(mix64(x + np.uint64(0x2545F4914F6CDD1D)), edge)
            cell = cell[edge]
            # a text with more empty parts than are spared has those too
            full = np.bincount(cell // m, minlength=len(texts))
            many = np.flatnonzero(m - full > spare)
            if len(many):
                have = np.zeros((len(many), m), bool)
                rank = np.full(len(texts), -1)
                rank[many] = np.arange(len(many))
                r = rank[cell // m]
                have[r[r >= 0], (cell % m)[r >= 0]] = True
                r, part = np.nonzero(~have)
                cell = np.concatenate([cell, many[r] * m + part])
                total = np.concatenate([total, np.zeros(len(r), np.uint64)])
            sigs.append(mix64(total + mix64((cell % m + lv * 1_000_003 + 1).astype(np.uint64))))
            docs.append(texts[cell // m])
    return np.concatenate(sigs), np.concatenate(docs)


def set_hash(g: np.ndarray, at: np.ndarray) -> np.ndarray:
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(g ^ np.uint64(0xA0761D6478BD642F)))])
    return mix64(sums[at[1:]] - sums[at[:-1]] + np.diff(at).astype(np.uint64)).view(np.int64)


def size_regions(size: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(region, cells there, region below or -1, cells there) of each text by its set size."""
    starts, a = [], 1
    while a <= max(int(size.max(initial=0)), 1):
        starts.append(a)
        a = max(a + 1, ceil(a * max(LADDER, 1.02 * den / num)))
    starts = np.array(starts)
    own = np.maximum(np.searchsorted(starts, size, "right") - 1, 0)
    least = -(-size * num // den)  # of the smallest partner

    def cells(partner: np.ndarray) -> np.ndarray:
        return np.where(size > 0, size - -(-num * (size + partner) // (num + den)) + 1, 0)

    below = (least < starts[own]) & (size > 0) & (own > 0)
    return own, cells(np.maximum(least, starts[own])), np.where(below, own - 1, -1), np.where(below, cells(least), 0)


def first_cells(g: np.ndarray, at: np.ndarray, rank: np.ndarray, num: int, den: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(cell keys in order, number of each text), in the texts' own regions and in those below. rank: each shingle's place in the order of rarity."""
    size = np.diff(at)
    doc = np.repeat(np.arange(len(size)), size)
    g = g[np.lexsort((g, rank, doc))]
    own, n_own, low, n_low = size_regions(size, num, den)
    out = []
    for region, n in ((own, n_own), (low, n_low)):
        idx = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(at[:-1], n)
        out.append((mix64(g[idx] ^ mix64(np.repeat(region + 1, n).astype(np.uint64))), n))
    return out


def _lists(values: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values.view(np.int64)))


def _row_key(doc_id: F.Column, text: F.Column) -> F.Column:
    """Tells rows by id and text."""
    return F.xxhash64(doc_id, doc_id.isNull(), text)


def _described(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n_shingles, cls, row) of every row; cls is null without shingles."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        n, cls = [], []
        for _, _, data, off in text_chunks(b.column(1)):
            h, first, _, _ = words(data, off, lower=True)
            g, at = shingle_sets(h, first, k)
            n.append(np.diff(at))
            cls.append(set_hash(g, at))
        size = np.concatenate(n)
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(np.concatenate(cls), mask=size == 0), b.column(2)], ["doc_id", "n_shingles", "cls", "row"])

    return map_batches(docs, run, "doc_id long, n_shingles long, cls long, row long")


def _packed(sig: np.ndarray, cls: np.ndarray) -> bytes:
    """Sorted projections byte by byte, and the classes as places in a list of them."""
    own, at = np.unique(cls, return_inverse=True)
    head = np.array([len(sig), len(own)], np.int64)
    planes = np.ascontiguousarray(sig.view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(b"".join(x.tobytes() for x in (head, own, planes, np.ascontiguousarray(at.astype(np.uint32).view(np.uint8).reshape(-1, 4).T))))


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, m = np.frombuffer(raw, np.int64, 2).tolist()
    own = np.frombuffer(raw, np.int64, m, 16)
    at = 16 + 8 * m
    sig = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * n, at).reshape(8, n).T).view(np.uint64).ravel()
    place = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 4 * n, at + 8 * n).reshape(4, n).T).view(np.uint32).ravel()
    return sig, own[place]


def _met(sig: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(classes that share a projection with another, for each that they share; sorted projections once, a class of each)."""
    order = np.lexsort((cls, sig))
    cls, sig = cls[order], sig[order]
    head = np.append(True, sig[1:] != sig[:-1])
    first = np.maximum.accumulate(np.where(head, np.arange(len(sig)), 0))
    other = cls != cls[first]
    return np.concatenate([cls[other], np.unique(cls[first[other]])]), sig[head], cls[head]


def _met_by_ranges(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """_met's classes of all pairs of (sorted projections, classes), one range of hashes after another: what is sorted at once is about STEP_ROWS."""
    if not held:
        return
    low, high = min(int(s[0]) for s, _ in held), max(int(s[-1]) for s, _ in held)
    ranges = sum(len(s) for s, _ in held) // STEP_ROWS + 1
    cuts = np.array([low + (high - low) * i // ranges for i in range(1, ranges)], np.uint64)
    at = [[0, *np.searchsorted(s, cuts).tolist(), len(s)] for s, _ in held]
    for r in range(ranges):
        sig, cls = (np.concatenate([pair[x][a[r] : a[r + 1]] for pair, a in zip(held, at, strict=True)]) for x in (0, 1))
        if len(sig):
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(_met(sig, cls)[0]))], ["cls"])


def _company(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(cls) of the texts that share a projection with another text. Those that share one inside a map step are known at once and only the first of them travels, so no projection has more rows than there are steps; a step's projections travel packed, a range of hashes to each bucket."""
    parts = parallelism(docs.sparkSession)
    arrow = pa.schema([("bucket", pa.int32()), ("blob", pa.binary()), ("cls", pa.int64())])

    def step(cls: np.ndarray, sig: np.ndarray) -> Iterator[pa.RecordBatch]:
        met, sig, cls = _met(sig, cls)
        met = np.unique(met)
        yield pa.RecordBatch.from_arrays([pa.array((mix64(met.view(np.uint64)) % np.uint64(parts)).astype(np.int32)), pa.nulls(len(met), pa.binary()), pa.array(met)], schema=arrow)
        bucket = ((sig >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)
        edge = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket))
        blobs = [_packed(sig[a:b], cls[a:b]) for a, b in zip(edge[:-1], edge[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(bucket[edge[:-1]]), pa.array(blobs, pa.binary()), pa.nulls(len(blobs), pa.int64())], schema=arrow)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            for _, _, data, off in text_chunks(b.column(0)):
                h, first, _, _ = words(data, off, lower=True)
                g, at = shingle_sets(h, first, k)
                s, d = signatures(g, at, num, den)
                held.append((set_hash(g, at)[d], s))
                n += len(s)
                if n >= STEP_ROWS:
                    yield from step(*map(np.concatenate, zip(*held, strict=True)))
                    held, n = [], 0
        if n:
            yield from step(*map(np.concatenate, zip(*held, strict=True)))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, []
        for b in batches:
            done = b.column(2).drop_null()
            if len(done):
                yield pa.RecordBatch.from_arrays([done], ["cls"])
            for i, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if blob is None:
                    continue
                if i != bucket:
                    yield from _met_by_ranges(held)
                    held = []
                bucket = i
                held.append(_unpacked(blob))
        yield from _met_by_ranges(held)

    packed = map_arrow(docs.select("text"), deal, "bucket int, blob binary, cls long")
    return map_arrow(packed.repartition(parts, "bucket").sortWithinPartitions("bucket"), meet, "cls long").distinct()


def _true_sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(cls, shingles text by text, first of each text and the end), run by run, of rows (cls, text) whose set it is: rows that only share a row key with one drop out."""
    for b in batches:
        want = np.asarray(b.column(0))
        for i, j, data, off in text_chunks(b.column(1)):
            h, first, _, _ = words(data, off, lower=True)
            g, at = shingle_sets(h, first, k)
            own, n = set_hash(g, at) == want[i:j], np.diff(at)
            if own.any():
                yield want[i:j][own], g[np.repeat(own, n)], np.concatenate([[0], np.cumsum(n[own])])


def _rarity(texts: DataFrame, k: int) -> np.ndarray:
    """Counts of all sets' shingles in ORDER_CELLS cells: one table a task, summed block by block."""
    blocks = 64
    wide = ORDER_CELLS // blocks

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(ORDER_CELLS, np.int64)
        for _, g, _ in _true_sets(batches, k):
            np.add.at(total, (g % np.uint64(ORDER_CELLS)).astype(np.int64), 1)
        if total.any():
            rows = [x.tobytes() for x in total.astype(np.int32).reshape(blocks, wide)]
            yield pa.RecordBatch.from_arrays([pa.array(range(blocks), pa.int32()), pa.array(rows, pa.binary())], ["block", "counts"])

    def add(t: pa.Table) -> pa.Table:
        total = np.zeros(wide, np.int64)
        for row in t.column("counts").to_pylist():
            total += np.frombuffer(row, np.int32)
        return pa.table({"block": pa.array([t.column("block")[0].as_py()], pa.int32()), "counts": pa.array([np.minimum(total, 2**31 - 1).astype(np.int32).tobytes()], pa.binary())})

    rows = map_arrow(texts, count, "block int, counts binary").groupBy("block").applyInArrow(add, "block int, counts binary").collect()
    out = np.zeros((blocks, wide), np.int32)
    for r in rows:
        out[r.block] = np.frombuffer(r.counts, np.int32)
    return out.ravel()


def _placed(texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(cls, size, pos, sig): the shingle cells of each set of (cls, text), in its own region and in the one below."""
    rarity = texts.sparkSession.sparkContext.broadcast(_rarity(texts, k))  # 4 bytes a cell, 4 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cls, g, at in _true_sets(batches, k):
            rank = rarity.value[(g % np.uint64(ORDER_CELLS)).astype(np.int64)]
            keys = [_lists(key, np.concatenate([[0], np.cumsum(count)])) for key, count in first_cells(g, at, rank, num, den)]
            yield pa.RecordBatch.from_arrays([pa.array(cls), pa.array(np.diff(at), pa.int64()), *keys], ["cls", "size", "own", "low"])

    cells = map_arrow(texts, run, "cls long, size long, own array<long>, low array<long>")
    cells = cells.select("cls", "size", F.explode(F.array("own", "low")).alias("keys"))
    return cells.select("cls", "size", F.posexplode("keys").alias("pos", "sig"))


def _shared(cells: DataFrame) -> DataFrame:
    """Members of cells with more than one class, in one shuffle; a cell's rows pass through a window, which spills."""
    cell = Window.partitionBy("sig")
    return cells.withColumn("differ", F.min("cls").over(cell) != F.max("cls").over(cell)).filter("differ").drop("differ")


def _sets(texts: DataFrame, k: int) -> DataFrame:
    """(cls, value) of each row of (cls, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cls, g, at in _true_sets(batches, k):
            yield pa.RecordBatch.from_arrays([pa.array(cls), _lists(g, at)], ["cls", "value"])

    return map_arrow(texts, run, "cls long, value array<long>")


def _links(members: DataFrame, sets: Callable[[DataFrame], DataFrame], num: int, den: int) -> DataFrame:
    """(cls, comp) of every class of members (sig, cls, pos, size), cells with at least two classes. sets: (cls, value) of given classes."""

    def may(m: str, p: str) -> F.Column:
        size, other = F.col(f"{m}.size"), F.col(f"{p}.size")
        reach = F.least(size - F.col(f"{m}.pos"), other - F.col(f"{p}.pos"))  # of the overlap, from this cell on
        return (F.least(size, other) * den >= F.greatest(size, other) * num) & (reach * (num + den) >= (size + other) * num)

    def measure(x: str, y: str) -> tuple[F.Column, F.Column]:
        both = F.size(F.array_intersect(x, y))
        all_ = F.size(x) + F.size(y) - both
        return 1 - both / all_, both * den >= all_ * num

    return regions.linked(members, sets, measure, 1 - num / den + 1e-9, may)


def _joined(docs: DataFrame, k: int, num: int, den: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, row, comp, low) of every row: its component and the smallest id there; comp is null without shingles."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    keyed = docs.withColumn("row", _row_key(F.col("doc_id"), F.col("text")))
    base = cut_lineage(_described(keyed.select("doc_id", "text", "row"), k), "described")
    with Scratch(docs.sparkSession) as steps:
        cls = base.filter("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("low"), F.min("row").alias("row"))
        company = _company(docs, k, num, den)
        wanted = steps.cut(company.join(cls, "cls").select("row", "cls"), "wanted")
        n_wanted = wanted.count()
        if n_wanted:
            repeated = base.join(wanted, "row", "left_semi").count() > n_wanted

            def texts(ids: DataFrame) -> DataFrame:
                rows = regions.few(wanted.join(regions.few(ids), "cls", "left_semi"))
                out = keyed.join(rows, "row").select("cls", "text")
                return out.dropDuplicates() if repeated else out

            # sets are made of the texts again whenever they are read: written, they would take more room than the texts
            members = steps.cut(_shared(_placed(texts(wanted.select("cls")), k, num, den)), "members")
            comp = _links(members, lambda ids: _sets(texts(ids), k), num, den)
            cls = cls.join(comp, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
            low = cls.groupBy("comp").agg(F.min("low").alias("low"))
            cls = cls.select("cls", "comp").join(low, "comp").select("cls", "comp", "low")
            cls = cut_lineage(cls, "classes")
            remove(comp)
        else:
            cls = cls.select("cls", F.col("cls").alias("comp"), "low")
    return base.join(cls, "cls", "left").select("doc_id", "n_shingles", "row", "comp", "low")


def components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: links join texts whose sets of k-word shingles have den * intersection >= num * union; component_id is the smallest id reachable."""
    return _joined(docs, k, num, den, id_col, text_col).select("doc_id", "n_shingles", F.coalesce("low", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs with one row of each component, one with the smallest doc_id there. Rows without an id or without shingles stay."""
    joined = _joined(docs, k, num, den)
    with Scratch(docs.sparkSession) as steps:
        rows = steps.cut(joined.filter("doc_id is not null and comp is not null").select("row", "comp", (F.col("doc_id") == F.col("low")).alias("least")), "rows")
        remove(joined)
        several = rows.filter("least").groupBy("comp").agg(F.min("row").alias("kept"), F.count("*").alias("n")).filter("n > 1")
        ties = cut_lineage(rows.filter("least").join(several, "comp").groupBy("row", "kept").agg(F.count("*").alias("n")), "ties")
        gone = cut_lineage(rows.filter("not least").select("row").union(ties.filter("row <> kept").select("row")).distinct(), "gone")
    repeated = ties.filter("row = kept and n > 1").select("row")

    def of(keys: DataFrame) -> DataFrame:
        keys = keys.withColumnRenamed("row", "row_")
        return F.broadcast(keys) if keys.count() <= regions.BROADCAST_IDS else keys

    left = docs.withColumn("row_", _row_key(F.col("doc_id").cast("long"), F.col("text"))).join(of(gone), "row_", "left_anti")
    if not repeated.isEmpty():
        left = left.join(of(repeated), "row_", "left_anti").unionByName(left.join(of(repeated), "row_", "left_semi").dropDuplicates(["row_"]))
    return left.drop("row_")


def op4_jaccard_metric_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(table(spark, sf_dir, "documents"), k=3, num=90, den=100)
