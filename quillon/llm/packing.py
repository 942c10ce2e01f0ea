"""Bounded-space online best-fit packing of tokenised documents into sequences.

Pieces arrive through a buffer of LOOKAHEAD pieces, of which the longest leaves first, so short ones come when gaps are open; the buffer is the same whatever batches they come in. A fixed number of bins stay open. One integer is the bitset of the free spaces that open bins have; the lowest set bit at or above a piece's length is the best fit. If no bin fits and all are open, the fullest (lowest set bit) closes and a new one opens. Each Spark partition packs its own documents, so nothing is shuffled; sequence ids carry the partition in their high bits.

Defined cases: a null text is empty (only the end id is packed). Only documents longer than the capacity are cut; the first piece takes the remainder, all others are full. Repeated rows are packed each on its own. An empty table gives no pieces. Other columns are ignored.
"""

from __future__ import annotations

import base64
import zlib
from array import array
from collections.abc import Iterator
from heapq import heappop, heappush, heappushpop

import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import map_arrow, table, texts_of


#: Pieces that wait to be placed.
LOOKAHEAD = 4096


class ByteBpe:
    """Ids of byte_bpe_50k.json as little-endian unsigned 32-bit strings.

    tiktoken holds the same vocabulary and pattern and is several times faster; a text that may hold the special string goes to the tokenizers library itself.
    """

    def __init__(self, json_path: str, ranks_path: str, pattern: str):
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.json_path = json_path
        self.whole = None

    def encode(self, text: str) -> bytes:
        if "<|" not in text:
            return array("I", self.bpe.encode_ordinary(text)).tobytes()
        if self.whole is None:
            from tokenizers import Tokenizer

            self.whole = Tokenizer.from_file(self.json_path)
        return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()


_loaded: dict[tuple, ByteBpe] = {}


def tokenizer(*paths: str) -> ByteBpe:
    if paths not in _loaded:
        _loaded[paths] = ByteBpe(*paths)
    return _loaded[paths]


class BestFit:
    """Bounded-space best fit: at most open_bins bins, keyed by free space in a bitset."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.open_bins = capacity, open_bins
        self.bits, self.count, self.made = 0, 0, 0
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def take(self, free: int) -> int:
        bins = self.bins[free]
        bin_ = bins.pop()
        if not bins:
            self.bits &= ~(1 << free)
        self.count -= 1
        return bin_

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) of a piece; 1 <= length <= capacity."""
        fitting = self.bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            bin_ = self.take(free)
        else:
            if self.count == self.open_bins:
                self.take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
            free, bin_ = self.capacity, self.made
            self.made += 1
        left = free - length
        if left:
            self.bins[left].append(bin_)
            self.bits |= 1 << left
            self.count += 1
        return bin_, self.capacity - free


def pack(docs: DataFrame, json_path: str, ranks_path: str, pattern: str, capacity: int = 1024, end_id: int = 2, open_bins: int = 8192, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 5]
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, bpe = BestFit(capacity, open_bins), tokenizer(json_path, ranks_path, pattern)
        base = TaskContext.get().partitionId() << 40
        waiting: list[tuple] = []
        arrived = 0

        def placed(pieces: list[tuple]) -> pa.RecordBatch:
            rows = []
            for piece in pieces:
                bin_, offset = bins.place(-piece[0])
                rows.append((piece[2], piece[3], piece[4], -piece[0], piece[5], base + bin_, offset))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * len(names), kinds, strict=True)], names)

        for b in batches:
            leaving = []
            for doc, text in zip(b.column(0).to_pylist(), texts_of(b.column(1)), strict=True):
                ids = bpe.encode(text) + end
                n = len(ids) // 4
                start, length = 0, n if n <= capacity else n % capacity or capacity
                piece = 0
                while start < n:
                    own = (-length, arrived, doc, piece, start, zlib.crc32(ids[4 * start : 4 * (start + length)]))
                    arrived += 1
                    if len(waiting) < LOOKAHEAD:
                        heappush(waiting, own)
                    else:
                        leaving.append(heappushpop(waiting, own))
                    start, length, piece = start + length, capacity, piece + 1
            if leaving:
                yield placed(leaving)
        if waiting:
            yield placed([heappop(waiting) for _ in range(len(waiting))])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return map_arrow(docs.select(F.col(id_col).cast("long"), F.col(text_col)), run, schema)


def pack_documents(docs: DataFrame) -> DataFrame:
    """Sequences of 1024 tokens of the public byte-level vocabulary, end id 2."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
