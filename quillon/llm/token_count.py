"""Token counts by heap-and-linked-list byte-pair merging.

A text's count is its initial symbols less the merges; no identifiers are made. Symbols are code points, a space standing for U+2581. The lowest-rank adjacent pair (leftmost among equals) is popped from a heap again and again; a linked list of live symbols gives the new neighbours. A code point that the vocabulary lacks counts as its UTF-8 bytes.

The vocabulary has no piece in which a space follows another character or in which a Latin letter stands beside another character (checked on loading), so merges never cross these borders: texts are cut there, each distinct part is merged once in a worker's life, and its count kept in a memory of bounded size.

Defined cases: a null text counts as the empty one (0 tokens, 0 bytes). A text of any length is counted whole, in time n log n of its longest part. An empty table gives no rows. Repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import re
from heapq import heapify, heappop, heappush

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import map_batches, table, texts_of

#: Parts that a worker remembers before it starts afresh.
MEMORY = 1_000_000
#: Characters of the longest part that is remembered: so the memory is bounded in bytes too.
REMEMBERED = 48
SPACE = "▁"
#: Spaces with what follows, Latin letters or all else: no piece reaches over the border of such a part.
LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
PARTS = re.compile(f"{SPACE}*(?:[{LATIN}]+|[^{LATIN}{SPACE}]+)|{SPACE}+")
_loaded: dict[str, "PieceCounter"] = {}


class Memo(dict):
    """Parts' counts, made on first use."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, part: str) -> int:
        c = self.make(part)
        if len(part) <= REMEMBERED:
            self[part] = c
        return c


class PieceCounter:
    """Counts tokens as a sentencepiece BPE model with byte fallback, identity normalisation and a dummy prefix does."""

    def __init__(self, model_path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(model_path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        kinds = {p.type for p in model.pieces}
        normal = model.SentencePiece.NORMAL
        if model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback or spec.precompiled_charsmap or not spec.add_dummy_prefix or spec.remove_extra_whitespaces or model.SentencePiece.USER_DEFINED in kinds:
            raise ValueError("only BPE models with byte fallback, identity normalisation, a dummy prefix and no user-defined pieces are counted")
        scores = {s: i for i, s in enumerate(sorted({p.score for p in model.pieces if p.type == normal}, reverse=True))}
        self.rank = {p.piece: scores[p.score] for p in model.pieces if p.type == normal}  # a higher score merges first
        self.single = {p for p in self.rank if len(p) == 1}
        if any(PARTS.fullmatch(p) is None for p in self.rank):
            raise ValueError("a piece crosses a border at which texts are cut")
        self.parts = Memo(self.merged_part)

    def merged_part(self, part: str) -> int:
        """Its symbols minus the merges that the heap allows. A heap entry holds a pair's rank above its place."""
        n = count = len(part)
        get = self.rank.get
        if n == 1:
            return 1 if part in self.rank else len(part.encode())
        if not self.single.issuperset(part):
            count += sum(len(c.encode()) - 1 for c in part if c not in self.single)
        shift = n.bit_length()
        mask = (1 << shift) - 1
        heap = [r << shift | i for i in range(n - 1) if (r := get(part[i : i + 2])) is not None]
        heapify(heap)
        sym = list(part)
        prev, nxt = list(range(-1, n - 1)), list(range(1, n + 1))
        while heap:
            key = heappop(heap)
            i = key & mask
            j = nxt[i]
            if j >= n or get(pair := sym[i] + sym[j]) != key >> shift:
                continue  # one of the two has been merged meanwhile
            sym[i] = pair
            count -= 1
            k = nxt[i] = nxt[j]
            nxt[j] = n
            if k < n:
                prev[k] = i
                if (r := get(pair + sym[k])) is not None:
                    heappush(heap, r << shift | i)
            k = prev[i]
            if k >= 0 and (r := get(sym[k] + pair)) is not None:
                heappush(heap, r << shift | k)
        return count

    def count(self, text: str) -> int:
        if not text:
            return 0
        parts = self.parts
        if len(parts) > MEMORY:
            parts.clear()
        return sum(map(parts.__getitem__, PARTS.findall(SPACE + text.replace(" ", SPACE))))  # the first is the dummy prefix


def counter(model_path: str) -> PieceCounter:
    if model_path not in _loaded:
        _loaded[model_path] = PieceCounter(model_path)
    return _loaded[model_path]


def token_counts(docs: DataFrame, model_path: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row; over_limit: more than limit tokens."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        c, texts = counter(model_path), texts_of(b.column(1))
        n = [c.count(t) for t in texts]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n])], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)), run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), 4096)
