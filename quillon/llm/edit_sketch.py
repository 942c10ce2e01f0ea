"""Fingerprints by randomised edit embedding.

A text is walked by shared random bits: at step j the walk emits the character it stands on and moves on if bit (j, character) is 1, so texts at a small edit distance fall into step again and their emissions differ at few steps (Hamming distance). A fingerprint samples SLOTS steps of the 2 n steps of a text of n code points; each slot takes the step whose hash is smallest among those, so texts of nearly the same length sample the same steps. What a sample keeps is 8 bits of the four characters ahead. The likeness of two fingerprints is the share of equal slots.

Banding joins texts that agree on all slots of a band, and every pair of a band's group is tried or excluded by a bound: two texts that differ in at most d slots agree on one of d + 1 parts of the slots outside the band, so large groups are dealt by these parts where that leaves fewer pairs. What is left is tried block by block, each pair in the first band and part that it shares. Where only the groups of alike texts are asked for, the pivots of each band's group and the triangle inequality (Hamming distance is a metric) join them without all pairs.

Two fingerprints of which a share s of the slots agree share a band with probability 1 - (1 - s^4)^16: 0.9998 at the threshold of 0.8, 0.78 at 0.55. The groups' cells are pairs of bands, which two fingerprints at the threshold share with probability 0.95.

Steps are taken for many texts at once, longest first; a partition's rows are a stream of batches of bounded size.

Defined cases: a null text is the empty text, whose fingerprint is that of nothing. Equal texts have equal fingerprints. The next document follows in descending doc_id, null ids last; rows with the same id follow each other by a hash of their text, equal rows being neighbours; a table of one row is followed by itself, an empty one gives no rows. Long texts are walked from end to end. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby
from math import floor

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm import regions
from quillon.llm.common import Scratch, cut_lineage, map_arrow, map_batches, mix64, parallelism, remove, table, texts_of
from quillon.operators.places import numbered

SLOTS = 64
BANDS = 16
#: Bands that near_groups takes together: one band of 4 slots alone puts most of a large group of distant copies in one cell.
BAND_PAIRS = [(i, (i + d) % BANDS) for i in range(BANDS) for d in (1, 5)]
#: Rows of the walk's table of bits; steps reuse them in turn.
ROWS = 8191
#: Characters that one vectorised walk takes on, unless a single text has more.
WALK_CHARS = 12 << 20
#: Members of a block of a band's group, about; larger groups are dealt.
BLOCK = 1000
#: Rows of a range of ids, about.
RANGE_ROWS = 20_000
#: Rows of the sample that a part's end is found in.
SAMPLED = 32

_state: dict[str, object] = {}


def _bits() -> np.ndarray:
    if "bits" not in _state:
        _state["bits"] = np.random.default_rng(61).integers(0, 2, (ROWS, 256), dtype=np.uint8).astype(np.int32)
    return _state["bits"]


def sample_steps(length: np.ndarray) -> np.ndarray:
    """(texts, SLOTS): for each slot the step below length with the smallest hash."""
    top = int(length.max(initial=1))
    have, records, low = _state.get("records", (0, [[] for _ in range(SLOTS)], np.full(SLOTS, 2**64 - 1, np.uint64)))
    while have < top:
        h = mix64(np.arange(have, have + 32768, dtype=np.uint64)[None, :] + (np.arange(1, SLOTS + 1, dtype=np.uint64) << np.uint64(40))[:, None])
        run = np.minimum.accumulate(np.minimum(h, low[:, None]), axis=1)
        new = run < np.concatenate([low[:, None], run[:, :-1]], axis=1)
        for slot, step in zip(*np.nonzero(new), strict=True):
            records[slot].append(have + int(step))
        low = run[:, -1]
        have += 32768
        _state["records"] = (have, records, low)
    out = np.empty((len(length), SLOTS), np.int64)
    for slot, r in enumerate(records):
        r = np.array(r)
        out[:, slot] = r[np.searchsorted(r, length) - 1]
    return out


def embed(texts: list[str]) -> np.ndarray:
    """(texts, SLOTS) bytes."""
    n = np.array([len(t) for t in texts], np.int64)
    if not len(n):
        return np.zeros((0, SLOTS), np.uint8)
    order = np.argsort(-n, kind="stable")
    n = n[order]
    pad = "\0\0\0\0"  # the walk ends here
    code = np.frombuffer("".join(x for i in order.tolist() for x in (texts[i], pad)).encode("utf-32-le", "surrogatepass"), np.uint32)
    char = (code ^ code >> np.uint32(8) ^ code >> np.uint32(16)).astype(np.uint8)
    x = code * np.uint32(2654435761)
    gram = x.copy()
    for i, k in enumerate((40503, 2246822519, 3266489917), 1):
        gram[:-i] += (x[i:] ^ x[i:] >> np.uint32(15)) * np.uint32(k)
    gram = (gram ^ gram >> np.uint32(13)) * np.uint32(668265263) >> np.uint32(24)
    gram = gram.astype(np.uint8)
    first = np.cumsum(n + 4) - (n + 4)
    last, at = first + n, first.copy()
    length = np.maximum(2 * n, 1)
    step = sample_steps(length)
    flat = step.ravel()
    by_step = np.argsort(flat, kind="stable")
    text_of = by_step // SLOTS
    steps, begin = np.unique(flat[by_step], return_index=True)
    begin = np.append(begin, len(flat)).tolist()
    steps = steps.tolist()
    out = np.empty(len(flat), np.uint8)
    # only walks that still have samples ahead go on
    until = step.max(1)
    until = np.maximum.accumulate(until[::-1])[::-1]  # longest first
    bits, j, k = _bits(), 0, 0
    active = len(n)
    while k < len(steps):
        if steps[k] == j:
            some = slice(begin[k], begin[k + 1])
            out[by_step[some]] = gram[at[text_of[some]]]
            k += 1
            while active and until[active - 1] <= j:
                active -= 1
        here = at[:active]
        here += bits[j % ROWS].take(char.take(here))
        np.minimum(here, last[:active], out=here)
        j += 1
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    return out.reshape(-1, SLOTS)[back]


def fingerprints(texts: list[str]) -> np.ndarray:
    """embed, a bounded number of characters at a time and equal texts once."""
    index: dict[str, int] = {}
    where = [index.setdefault(t, len(index)) for t in texts]
    parts, some, size = [], [], 0
    for t in index:
        some.append(t)
        size += len(t)
        if size >= WALK_CHARS:
            parts.append(embed(some))
            some, size = [], 0
    parts.append(embed(some))
    return np.concatenate(parts)[where]


def _before(cut_keys: np.ndarray, cut_hashes: np.ndarray, key: np.ndarray, hash_: np.ndarray) -> np.ndarray:
    """How many of the cuts (key, hash), ascending, lie before each row."""
    low, high = np.searchsorted(cut_keys, key, "left"), np.searchsorted(cut_keys, key, "right")
    tied = np.flatnonzero(low < high)
    for k in np.unique(key[tied]):  # keys that are cuts
        own = tied[key[tied] == k]
        low[own] += np.searchsorted(cut_hashes[low[own[0]] : high[own[0]]], hash_[own], "left")
    return low


def _cuts(docs: DataFrame, parts: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and hashes of about parts - 1 rows that deal docs (key, hash) evenly: every SAMPLED-th of a sample of rows, sorted in slices."""
    some = cut_lineage(docs.filter(F.pmod(F.xxhash64("key", "hash"), F.lit(max(1, rows // (parts * SAMPLED)))) == 0).select("key", "hash").distinct(), "sample")
    step = max(1, some.count() // parts)
    ends = numbered(some, [], [F.col("key"), F.col("hash")]).filter(F.col("place") % step == 0).select("key", "hash").collect()  # a row a part
    return tuple(np.array(c, np.int64) for c in zip(*sorted((r.key, r.hash) for r in ends), strict=True)) if ends else (np.zeros(0, np.int64),) * 2


def _in_order(docs: DataFrame) -> DataFrame:
    """(part, lent, doc_id, text), a part's rows together in order, after them the first row of the part that follows. Parts are ranges of id and hash of text, so rows of one id, or without one, lie in as many as they fill. Two rows of numbers a part, its end and its first row, go to all tasks."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # descending id, then ascending hash: the reverse of both ascending
    docs = docs.withColumn("key", F.coalesce("doc_id", F.lit(-(1 << 63)))).withColumn("hash", F.bitwise_not(F.xxhash64("text")))
    rows = docs.count()
    parts = max(parallelism(spark), rows // RANGE_ROWS)
    ends = spark.sparkContext.broadcast(_cuts(docs, parts, rows))

    @F.pandas_udf("int")
    def part_of(key: pd.Series, hash_: pd.Series) -> pd.Series:
        return pd.Series(_before(*ends.value, key.to_numpy(), hash_.to_numpy()).astype(np.int32))

    tops = docs.select(part_of("key", "hash").alias("part"), "key", "hash").groupBy("part").agg(F.max(F.struct("key", "hash")).alias("top")).orderBy("part").collect()  # a row a part
    top = spark.sparkContext.broadcast((np.array([r.part for r in tops], np.int32), *(np.array([r.top[c] for r in tops], np.int64) for c in ("key", "hash"))))

    @F.pandas_udf("struct<part:int,before:int>")
    def places(key: pd.Series, hash_: pd.Series) -> pd.DataFrame:
        """The row's part and, where it comes first there, the part before it in descending order, else -1."""
        have, top_key, top_hash = top.value
        part = _before(*ends.value, key.to_numpy(), hash_.to_numpy()).astype(np.int32)
        at = np.searchsorted(have, part)
        lends = (top_key[at] == key.to_numpy()) & (top_hash[at] == hash_.to_numpy())
        return pd.DataFrame({"part": part, "before": np.where(lends, have[(at + 1) % len(have)], -1).astype(np.int32)})

    both = docs.withColumn("p", places("key", "hash"))
    every = F.when(F.col("p.before") < 0, F.array("p.part")).otherwise(F.array("p.part", "p.before"))
    dealt = both.select("doc_id", "text", "key", "hash", F.posexplode(every).alias("lent", "part")).withColumn("lent", F.col("lent") > 0)
    return dealt.repartition(parts, "part").sortWithinPartitions("part", "lent", F.desc("key"), F.desc("hash")).select("part", "lent", "doc_id", "text")


def _edited(text: str, after: str) -> str:
    cut = len(text) // 3
    return text[: len(text) - cut] + after[:cut]


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited form, and their likenesses."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def rows_of(rows: list[tuple]) -> pa.RecordBatch | None:
        """rows: (part, lent, doc_id, text); the last only follows."""
        pairs = [i for i in range(len(rows) - 1) if not rows[i][1]]
        if not pairs:
            return None
        texts = [r[3] for r in rows]
        edited = [_edited(texts[i], texts[i + 1]) for i in pairs]
        both = fingerprints(texts + edited)
        plain, other = both[: len(texts)], both[len(texts) :]
        i = np.array(pairs)
        cols = [
            [rows[k][2] for k in pairs], [len(texts[k]) for k in pairs], [hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edited],
            [plain[k].tobytes().hex() for k in pairs], [x.tobytes().hex() for x in other], (plain[i] == other).mean(1), (plain[i] == plain[i + 1]).mean(1),
        ]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in range(4)), strict=True):
                held.append(row)
                size += len(row[3])
                if size >= WALK_CHARS // 2 and not row[1]:
                    out = rows_of(held)
                    if out is not None:
                        yield out
                    held, size = [row], len(row[3])
        out = rows_of(held)
        if out is not None:
            yield out

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return map_arrow(_in_order(docs), run, schema)


def sketch(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of every row."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column(0), pa.array([f.tobytes().hex() for f in fingerprints(texts_of(b.column(1)))], pa.string())], ["doc_id", "fingerprint"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, fingerprint string")


def likeness(a: str, b: str) -> F.Column:
    """Share of equal slots of two fingerprint columns."""
    same = F.expr(f"filter(sequence(0, {SLOTS - 1}), i -> substring({a}, 2 * i + 1, 2) = substring({b}, 2 * i + 1, 2))")
    return F.size(same) / SLOTS


def _part_edges(threshold: float) -> list[int]:
    """First slots, outside a band, of the parts of which texts so alike agree on one, and the end; none where there are more parts than slots."""
    parts, rest = floor(SLOTS * (1 - threshold) + 1e-9) + 1, SLOTS - SLOTS // BANDS
    return [rest * p // parts for p in range(parts + 1)] if parts <= rest else []


def _cells(prints: DataFrame, threshold: float) -> DataFrame:
    """(fingerprint, band, part, cell, side): members that are tried with each other, side 0, or those of side 1 with those of side 2."""
    width = 2 * SLOTS // BANDS
    bands = prints.select("fingerprint", F.explode(F.array(*[F.struct(F.lit(i).alias("band"), F.substring("fingerprint", width * i + 1, width).alias("key")) for i in range(BANDS)])).alias("b")).select("fingerprint", "b.*")
    sized = bands.join(bands.groupBy("band", "key").agg(F.count("*").alias("n")).filter("n > 1"), ["band", "key"])
    cells = sized.select("fingerprint", "band", "key", F.lit(-1).alias("part"), F.lit("").alias("part_key"), "n")
    edges = _part_edges(threshold)
    if edges:
        rest = sized.filter(F.col("n") > BLOCK).withColumn("rest", F.expr(f"concat(left(fingerprint, {width} * band), substring(fingerprint, {width} * (band + 1) + 1))"))
        parts = F.array(*[F.struct(F.lit(p).alias("part"), F.substring("rest", 2 * a + 1, 2 * (b - a)).alias("part_key")) for p, (a, b) in enumerate(zip(edges, edges[1:]))])
        finer = rest.select("fingerprint", "band", "key", F.col("n").alias("all_"), F.explode(parts).alias("p")).select("fingerprint", "band", "key", "all_", "p.*")
        counts = finer.groupBy("band", "key", "all_", "part", "part_key").agg(F.count("*").alias("n"))
        split = counts.groupBy("band", "key", "all_").agg(F.sum(F.col("n").cast("double") * F.col("n")).alias("work")).filter("work < cast(all_ as double) * all_").select("band", "key")
        fine = finer.drop("all_").join(counts.drop("all_").filter("n > 1").join(split, ["band", "key"], "left_semi"), ["band", "key", "part", "part_key"])
        cells = cells.join(split, ["band", "key"], "left_anti").unionByName(fine)
    slices = F.ceil(F.col("n") / BLOCK)
    cells = cells.withColumn("own", F.pmod(F.xxhash64("fingerprint"), slices)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), slices - 1)))
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    return cells.select("fingerprint", "band", "part", F.xxhash64("band", "key", "part", "part_key", F.least("own", "other"), F.greatest("own", "other")).alias("cell"), side.alias("side"))


def near_pairs(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(fingerprint, near, likeness) of different fingerprints that share a band and are at least so alike; join with sketch() for the rows of each."""
    starts = np.array(_part_edges(threshold)[:-1], np.int64)
    each = SLOTS // BANDS

    def tried(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        """rows: (fingerprint, band, part, cell, side) of one cell."""
        names = np.array([r[0] for r in rows])
        x = np.frombuffer(bytes.fromhex("".join(names.tolist())), np.uint8).reshape(-1, SLOTS)
        side = np.array([r[4] for r in rows])
        _, band, part, _, _ = rows[0]
        left, right = (np.flatnonzero((side == 0) | (side == k)) for k in (1, 2))
        for i in range(0, len(left), 64):
            own = left[i : i + 64]
            equal = (x[own][:, None] == x[right][None]).sum(-1)
            a, b = np.nonzero(equal / SLOTS >= threshold)
            share = equal[a, b] / SLOTS
            a, b = own[a], right[b]
            once = a < b if side[0] == 0 else np.ones(len(a), bool)
            a, b, share = a[once], b[once], share[once]
            if not len(a):
                continue
            same = x[a] == x[b]
            first = same.reshape(-1, BANDS, each).all(-1).argmax(1) == band
            if part >= 0:
                first &= np.logical_and.reduceat(np.delete(same, np.s_[band * each : (band + 1) * each], 1), starts, 1).argmax(1) == part
            a, b, share = a[first], b[first], share[first]
            yield pa.RecordBatch.from_arrays([pa.array(np.where(names[a] < names[b], names[b], names[a]).tolist(), pa.string()), pa.array(np.where(names[a] < names[b], names[a], names[b]).tolist(), pa.string()), pa.array(share)], ["fingerprint", "near", "likeness"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for _, own in groupby(rows, lambda r: r[3]):
            yield from tried(list(own))

    cells = _cells(sketch(docs).select("fingerprint").distinct(), threshold)
    return map_arrow(cells.repartition("cell").sortWithinPartitions("cell"), run, "fingerprint string, near string, likeness double")


def near_groups(prints: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(fingerprint, near_id) of every fingerprint of prints (doc_id, fingerprint): the smallest doc_id that is reached by steps between fingerprints that share two of the bands in BAND_PAIRS and are at least so alike."""
    width = 2 * SLOTS // BANDS
    with Scratch(prints.sparkSession) as steps:
        own = steps.cut(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("low")).withColumn("cls", F.xxhash64("fingerprint")), "prints")
        twice = [F.xxhash64(F.lit(i), F.lit(j), F.substring("fingerprint", width * i + 1, width), F.substring("fingerprint", width * j + 1, width)) for i, j in BAND_PAIRS]
        cells = own.select("cls", F.explode(F.array(*twice)).alias("sig"))
        several = cells.groupBy("sig").agg(F.min("cls").alias("a"), F.max("cls").alias("b")).filter("a <> b").select("sig")
        members = steps.cut(cells.join(several, "sig", "left_semi").distinct(), "bands")
        comp = regions.linked(members, lambda ids: own.join(regions.few(ids), "cls", "left_semi").select("cls", "fingerprint"), lambda x, y: (1 - likeness(x, y), likeness(x, y) >= threshold), 1 - threshold + 1e-9, by_degree=False)
        own_comp = own.join(comp, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
        low = own_comp.groupBy("comp").agg(F.min("low").alias("near_id"))
        out = cut_lineage(own_comp.join(low, "comp").select("fingerprint", "near_id"), "near")
        remove(comp)
    return out


def op6_edit_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(table(spark, sf_dir, "documents"))
