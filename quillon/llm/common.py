"""Shared pieces of the text operators: Arrow plumbing and vectorised word hashing."""

from __future__ import annotations

import ctypes
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that one vectorised step works on.
CHUNK_BYTES = 1 << 20
#: Rows of an Arrow batch.
BATCH_ROWS = 2000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir). Only a session on one machine may leave that unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "/tmp/quillon-shared"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Shuffle files of a written table go when it is written, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _write(df: DataFrame, path: str) -> DataFrame:
    spark = df.sparkSession
    had = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if had is None else spark.conf.set(CLEANUP, had)
    return spark.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: later jobs don't redo it, lost executors don't lose it."""
    return _write(df, shared_path(df.sparkSession, name))


class Scratch:
    """Tables of an operator's steps. On leaving, they are deleted from the shared folder: what is made of them must have been written by then."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        return self

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        """cut_lineage, to be deleted later."""
        path = shared_path(self.spark, name)
        out = _write(df, path)
        self.paths.append(path)
        return out

    def __exit__(self, *_) -> None:
        for path in self.paths:
            delete(self.spark, path)


def remove(*tables: DataFrame) -> None:
    """Delete the tables of the shared folder that these read: what was made of them must have been written."""
    for df in tables:
        root = _plain(shared_path(df.sparkSession, "")).rsplit("/", 1)[0]
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if re.fullmatch(re.escape(root) + r"/[A-Za-z_-]+-[0-9a-f]{32}", _plain(path)):
                delete(df.sparkSession, path)


def _plain(path: str) -> str:
    """Without its scheme."""
    return re.sub(r"^[a-z]+:/+", "/", path)


def delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def parallelism(spark: SparkSession) -> int:
    """The session's number of shuffle partitions, which the cluster sizes to its input."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow over batches of BATCH_ROWS rows at most: texts are long, and a batch is held several times over."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(key)) <= BATCH_ROWS:
        df.sparkSession.conf.set(key, BATCH_ROWS)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return df.mapInArrow(whole, schema)


def give_back() -> None:
    """Return what a partition's arrays took to the system: workers live on for other tasks, and what they keep is missing in the executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries have it
    if trim:
        trim(0)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """One Arrow batch in, at most one out; state stays inside fn's batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                out = fn(b)
                if out is not None and out.num_rows:
                    yield out

    return map_arrow(df, run, schema)


def texts_of(col: pa.Array) -> list[str]:
    """Python strings; null is the empty text."""
    return [t or "" for t in col.to_pylist()]


def text_chunks(col: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about limit bytes; a longer text is a run of its own."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string()).fill_null("")
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None and off[-1] else np.zeros(0, np.uint8)
    i = 0
    while i < len(col):
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


_WS = np.zeros(256, bool)
_WS[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of SplitMix64 (public domain): a bijection on 64 bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        m = max(n, CHUNK_BYTES + 1)
        for key, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.full(m, base, np.uint64)
            p[0] = 1
            _powers[key] = np.multiply.accumulate(p)
    return _powers["up"][:n], _powers["down"][:n]


def words(data: np.ndarray, off: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words [^\\x20\\x09-\\x0D]+ of the texts data[off[i]:off[i+1]]: (64-bit hashes, first word of each text and the end, byte starts, byte ends)."""
    if lower:
        data = _LOWER[data]
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64), z, z
    word = ~_WS[data]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    edge[1:] |= ~word
    start = np.flatnonzero(word & edge[:-1])
    edge[:] = False
    edge[off] = True
    edge[:-1] |= ~word
    end = np.flatnonzero(word & edge[1:]) + 1
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:n], out=sums[1:])
    h = mix64((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))
    return h, np.searchsorted(start, off), start, end


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Order-sensitive 64-bit hashes of every k consecutive hashes; runs across text borders are the caller's to leave out."""
    m = len(h) - k + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for i in range(k):
        out = out * np.uint64(0xD6E8FEB86659FD93) + h[i : i + m]
    return mix64(out)


def within(first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions where k consecutive words lie in one text, and their text's index; first as words() gives it."""
    count = np.maximum(np.diff(first) - k + 1, 0)
    doc = np.repeat(np.arange(len(count)), count)
    pos = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first[:-1], count)
    return pos, doc
