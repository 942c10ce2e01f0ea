"""Media columns: texts stored as lossless WebP and read back.

Each payload is UTF-8 padded with spaces to a positive multiple of 192 bytes, one row of 48 pixels of 4 samples. The stored bytes are decoded again and everything but their own size and hash is computed from the pixels that come back. The codec is quillon.llm.webp.

Features of an image: the share of its samples in each of 16 levels, the mean step between neighbouring pixels, and the mean of each channel, all in whole numbers.

Defined cases: a null text is the empty one (192 spaces). Very long texts become animations of frames of 64 rows. Equal texts have equal values. Repeated rows get a row each, an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import webp
from quillon.llm.common import map_batches, table, texts_of

ROW_BYTES = 4 * webp.WIDTH
#: Bytes of text that are encoded and decoded at once, unless one text has more.
AT_ONCE = 3 << 20


def payload_of(text: str) -> bytes:
    raw = text.encode("utf-8", "surrogatepass")
    return raw + b" " * (-len(raw) % ROW_BYTES if raw else ROW_BYTES)


def feature(px: np.ndarray) -> str:
    raw = np.ascontiguousarray(px, "<u4").view(np.uint8)
    levels = np.bincount(raw >> 4, minlength=16) * 1000 // len(raw)
    samples = raw.reshape(-1, 4).astype(np.int32)
    step = int(np.abs(np.diff(samples, axis=0)).sum()) * 100 // max(1, 4 * (len(samples) - 1))
    return ",".join(map(str, [*levels.tolist(), step, *(samples.sum(0, dtype=np.int64) * 100 // len(samples)).tolist()]))


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): the stored form of each text."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = texts_of(b.column(1))
        return pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64()), pa.array(webp.write_files([payload_of(t) for t in texts]), pa.binary())], ["doc_id", "n_bytes", "media"])

    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)), run, "doc_id long, n_bytes long, media binary")


def load(media: DataFrame, media_col: str = "media") -> DataFrame:
    """media's columns with pixels, the ARGB values of each stored image (frames one after the other); null media has null pixels."""
    at, names = media.columns.index(media_col), media.columns

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        files = b.column(at).to_pylist()
        got = iter(webp.read_files([f for f in files if f is not None]))
        px = pa.array([None if f is None else next(got).astype(np.int64) for f in files], pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([*b.columns, px], [*names, "pixels"])

    return map_batches(media, run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in media.schema.fields) + ", pixels array<bigint>")


def digest(docs: DataFrame) -> DataFrame:
    """What op1 returns: sizes and hashes of the payload as read back and of the stored form, and the features."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def rows(texts: list[str]) -> list[tuple]:
        payloads = [payload_of(t) for t in texts]
        files = webp.write_files(payloads)
        out = []
        for text, file, px in zip(texts, files, webp.read_files(files), strict=True):
            back = np.ascontiguousarray(px, "<u4").tobytes()
            n = len(text.encode("utf-8", "surrogatepass"))
            out.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(file), hashlib.sha256(file).hexdigest(), feature(px)))
        return out

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = texts_of(b.column(1))
        index: dict[str, int] = {}
        where = [index.setdefault(t, len(index)) for t in texts]
        done, some, size = [], [], 0
        for t in index:
            some.append(t)
            size += len(t) + ROW_BYTES
            if size >= AT_ONCE:
                done += rows(some)
                some, size = [], 0
        if some:
            done += rows(some)
        cols = zip(*(done[i] for i in where), strict=True)
        return pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds[1:], strict=True))], names)

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, schema)


def op1_lossless_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"))
