"""Collocations: phrases of two and three words that come together more often than their parts suggest, counted in quotient filters.

Words that come at least LEAST times in their language get numbers; a phrase with a rarer word can't be a candidate, nor a part of one. An n-gram is its words' numbers side by side in one field of bits. An invertible permutation (four Feistel rounds) spreads the fields evenly. The permuted field is cut in a quotient, which says where in the filter it stands, and a remainder, which is stored in full; so a filter is exact and gives back its n-grams. Counts stand beside the remainders, a byte each unless they are large.

Each map step counts some STEP_WORDS words and sorts its n-grams once; its filter is split by the first bits of the quotient into shards. A shard's filters, sorted all, are merged where they meet, one shard after another. A word that fills a third of all texts costs a step no more than any other, and its phrases lie in all shards.

Up to DICTIONARY numbered words are broadcast. Beyond that, texts are dealt into blocks, each of which meets the numbers of its own words; the rows are the same.

Defined cases: a null text is empty, a null lang is und. Other columns are ignored, whatever their names. Rows that agree in everything count each. Texts of any length are read whole; no texts give no rows.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm.common import cut_lineage, map_arrow, mix64, parallelism, table
from quillon.operators import places

#: Times that a candidate comes.
LEAST = 10
#: Numbered words that are broadcast at most: some 150 bytes each in a worker.
DICTIONARY = 500_000
#: Words that a map step counts together, and about as many of whose n-grams make a shard.
STEP_WORDS, SHARD_WORDS = 2_000_000, 4_000_000
#: Distinct words that a map step holds before it passes their counts on, n-grams that are held before they are merged.
HELD_WORDS, HELD_GRAMS = 300_000, 3_000_000
#: Parts that a language's candidates are first ranked in.
PARTS = 64

_BREAK = b"\xff"  # no byte of UTF-8
_TABLE = bytes.maketrans(bytes(range(65, 91)) + b"\t.,;:!?\n\x0b\x0c\r", bytes(range(97, 123)) + b" " + _BREAK * 10)
_ROUNDS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


def tokens(text: str) -> list[bytes]:
    """Lower-case words, with _BREAK between pieces."""
    return text.encode().translate(_TABLE).replace(_BREAK, b" \xff ").split(b" ")


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, f), and with a null word the number of all words of a language. docs: (lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = defaultdict(Counter)
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held[lang].update(tokens(text))
                if sum(map(len, held.values())) > HELD_WORDS:
                    yield from rows(held)
                    held.clear()
        yield from rows(held)

    def rows(held: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, counts in held.items():
            counts.pop(b"", None)
            counts.pop(_BREAK, None)
            names = [None, *(w.decode() for w in counts)]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(names), pa.string()), pa.array(names, pa.string()), pa.array([counts.total(), *counts.values()], pa.int64())], ["lang", "word", "f"])

    return map_arrow(docs, run, "lang string, word string, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))


class Field:
    """n numbers of b bits as two halves of w bits, permuted and back."""

    def __init__(self, n: int, b: int):
        self.n, self.b, self.w = n, b, -(-n * b // 2)
        self.mask = np.uint64((1 << self.w) - 1)

    def pack(self, ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        b, x = np.uint64(self.b), [i.astype(np.uint64) for i in ids]
        if self.n == 2:
            left, right = x
        else:  # the second number lies across both halves
            low = np.uint64(self.w - self.b)
            left = (x[0] << (b - low)) | (x[1] >> low)
            right = ((x[1] & ((np.uint64(1) << low) - np.uint64(1))) << b) | x[2]
        for r in _ROUNDS:
            left, right = right, left ^ (mix64(right + r) & self.mask)
        return left, right

    def unpack(self, left: np.ndarray, right: np.ndarray) -> list[np.ndarray]:
        for r in reversed(_ROUNDS):
            left, right = right ^ (mix64(left + r) & self.mask), left
        if self.n == 2:
            out = [left, right]
        else:
            b, low = np.uint64(self.b), np.uint64(self.w - self.b)
            word = (np.uint64(1) << b) - np.uint64(1)
            out = [left >> (b - low), ((left << low) & word) | (right >> b), right & word]
        return [o.astype(np.int64) for o in out]

    def counted(self, left: np.ndarray, right: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct fields, ascending, with the sums of n (1 each without)."""
        if not len(left):
            return left, right, np.zeros(0, np.int64)
        if 2 * self.w <= 64:
            x = (left << np.uint64(self.w)) | right
            if n is None:
                x = np.sort(x)
            else:
                order = np.argsort(x, kind="stable")  # sorted runs are merged
                x, n = x[order], n[order]
            left, right = x >> np.uint64(self.w), x & self.mask
        else:
            order = np.lexsort((right, left))
            left, right, n = left[order], right[order], None if n is None else n[order]
        at = np.flatnonzero(np.concatenate([[True], (left[1:] != left[:-1]) | (right[1:] != right[:-1])]))
        total = np.diff(np.append(at, len(left))) if n is None else np.add.reduceat(n, at)
        return left[at], right[at], total

    def write(self, left: np.ndarray, right: np.ndarray, n: np.ndarray, given: int) -> bytes:
        """The filter of distinct fields, ascending, that agree in the first given bits: the quotients' run lengths, one bit more for each; remainders and counts by their bytes."""
        rest = self.w - given
        q = min(rest, max(0, len(left).bit_length() - 1))
        left = left & np.uint64((1 << rest) - 1)
        quotient = (left >> np.uint64(rest - q)).astype(np.int64)
        bits = np.zeros(len(left) + (1 << q), bool)
        bits[quotient + np.arange(len(left))] = True
        large = n >= 255
        parts = [np.array([len(left), q, large.sum()], np.int64).tobytes(), np.packbits(bits).tobytes()]
        for half, width in ((left & np.uint64((1 << (rest - q)) - 1), rest - q), (right, self.w)):
            parts += [((half >> np.uint64(8 * i)) & np.uint64(255)).astype(np.uint8).tobytes() for i in range(-(-width // 8))]
        return b"".join([*parts, np.where(large, 255, n).astype(np.uint8).tobytes(), n[large].astype(np.int64).tobytes()])

    def read(self, blob: bytes, shard: int, given: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size, q, large = np.frombuffer(blob, np.int64, 3)
        rest, at = self.w - given, 24
        many = int(size) + (1 << int(q))
        bits = np.unpackbits(np.frombuffer(blob, np.uint8, -(-many // 8), at), count=many)
        at += -(-many // 8)
        quotient = np.flatnonzero(bits) - np.arange(size)
        halves = []
        for width in (rest - int(q), self.w):
            half = np.zeros(size, np.uint64)
            for i in range(-(-width // 8)):
                half |= np.frombuffer(blob, np.uint8, size, at).astype(np.uint64) << np.uint64(8 * i)
                at += int(size)
            halves.append(half)
        n = np.frombuffer(blob, np.uint8, size, at).astype(np.int64)
        if large:
            n[n == 255] = np.frombuffer(blob, np.int64, large, at + int(size))
        left = (np.uint64(shard) << np.uint64(rest)) | (quotient.astype(np.uint64) << np.uint64(rest - int(q))) | halves[0]
        return left, halves[1], n


def _filters(lang: str, ids: np.ndarray, b: int, shards: int) -> Iterator[tuple]:
    """(lang, n, shard, filter) of a map step's words, -1 between runs of them. shards: bits that tell shards apart."""
    for n in (2, 3):
        field = Field(n, b)
        given = min(shards, field.w)
        window = [ids[i : len(ids) - n + 1 + i] for i in range(n)]
        whole = np.logical_and.reduce([w >= 0 for w in window])
        left, right, count = field.counted(*field.pack([w[whole] for w in window]))
        edge = np.searchsorted(left >> np.uint64(field.w - given), np.arange((1 << given) + 1, dtype=np.uint64))
        for s in np.flatnonzero(np.diff(edge)):
            own = slice(edge[s], edge[s + 1])
            yield lang, n, int(s), field.write(left[own], right[own], count[own], given)


_FILTERS = "lang string, n int, shard int, filter binary"


def _arrow(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.int32(), pa.binary()), strict=True)], ["lang", "n", "shard", "filter"])


class _Steps:
    """Numbers of words by language until there are enough for a step."""

    def __init__(self, b: int, shards: int):
        self.b, self.shards, self.held, self.size = b, shards, defaultdict(list), 0

    def add(self, lang: str, text: str, number: dict[bytes, int]) -> None:
        found = tokens(text)
        ids = np.fromiter(map(number.get, filter(None, found), repeat(-1)), np.int64)
        self.held[lang] += [ids, np.array([-1])]
        self.size += len(ids)

    def filters(self) -> Iterator[tuple]:
        for lang, ids in self.held.items():
            yield from _filters(lang, np.concatenate(ids), self.b, self.shards)
        self.held.clear()
        self.size = 0


def _numbers(rows) -> dict[str, dict[bytes, int]]:
    out: dict[str, dict[bytes, int]] = defaultdict(dict)
    for lang, word, i in rows:
        out[lang][word.encode()] = i
    return out


def local_filters(docs: DataFrame, words: DataFrame, size: int, b: int, shards: int, total: int, most: int) -> tuple[DataFrame, object]:
    """(lang, n, shard, filter) of all map steps, and what was broadcast. docs: (key, lang, text); words: (lang, word, id)."""
    if size <= most:
        sent = docs.sparkSession.sparkContext.broadcast(dict(_numbers(words.select("lang", "word", "id").toLocalIterator())))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            steps = _Steps(b, shards)
            for batch in batches:
                for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    steps.add(lang, text, sent.value.get(lang, {}))
                    if steps.size >= STEP_WORDS:
                        yield from (_arrow([f]) for f in steps.filters())
            yield from (_arrow([f]) for f in steps.filters())

        return map_arrow(docs.select("lang", "text"), run, _FILTERS), sent

    blocks = max(1, -(-total // STEP_WORDS))
    dealt = docs.select(F.pmod(F.xxhash64("key", "text"), F.lit(blocks)).alias("block"), "lang", "text")

    def vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = {(k, lang, w) for k, lang, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True) for w in set(tokens(text)) if w not in (b"", _BREAK)}
            k, lang, w = zip(*own, strict=True) if own else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(lang, pa.string()), pa.array([x.decode() for x in w], pa.string())], ["block", "lang", "word"])

    own = map_arrow(dealt, vocabulary, "block long, lang string, word string").distinct().join(words.select("lang", "word", "id"), ["lang", "word"])

    def count(texts: pd.DataFrame, numbered: pd.DataFrame) -> pd.DataFrame:
        number, steps = _numbers(zip(numbered["lang"], numbered["word"], numbered["id"], strict=True)), _Steps(b, shards)
        for lang, text in zip(texts["lang"], texts["text"], strict=True):
            steps.add(lang, text, number[lang])
        return pd.DataFrame(list(steps.filters()), columns=["lang", "n", "shard", "filter"])

    return dealt.groupBy("block").cogroup(own.groupBy("block")).applyInPandas(count, _FILTERS), None


def merged(filters: DataFrame, b: int, shards: int, least: int) -> DataFrame:
    """(w1, w2, w3, f): n-grams of all filters that come at least least times; w3 is null for two words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, size = None, [], 0

        def together(field: Field) -> tuple:
            return held[0] if len(held) == 1 else field.counted(*(np.concatenate(x) for x in zip(*held, strict=True)))

        def out() -> pa.RecordBatch:
            field = Field(key[1], b)
            left, right, n = together(field)
            some = n >= least
            ids = field.unpack(left[some], right[some])
            third = pa.array(ids[2]) if key[1] == 3 else pa.nulls(int(some.sum()), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(ids[0]), pa.array(ids[1]), third, pa.array(n[some])], ["w1", "w2", "w3", "f"])

        for batch in batches:
            for lang, n, shard, blob in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if (lang, n, shard) != key:
                    if key is not None:
                        yield out()
                    key, held, size = (lang, n, shard), [], 0
                field = Field(n, b)
                held.append(field.read(blob, shard, min(shards, field.w)))
                size += len(held[-1][0])
                if size > HELD_GRAMS and len(held) > 1:
                    held = [together(field)]
                    size = len(held[0][0]) // 2  # merged again when half as many have come
        if key is not None:
            yield out()

    names = ["lang", "n", "shard"]
    dealt = filters.repartition(parallelism(filters.sparkSession), *names).sortWithinPartitions(*names)
    return map_arrow(dealt, run, "w1 long, w2 long, w3 long, f long")


def score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (left right)), in whole numbers of 38 digits."""
    a, left, right = (x.cast("decimal(19,0)") for x in (a, left, right))
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * (a * a), left * right)


def collocations(docs: DataFrame, least: int = LEAST, top: int = 2000, key_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = DICTIONARY) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's top phrases. key_col only spreads texts over blocks."""
    spark = docs.sparkSession
    docs = docs.select(F.col(key_col).alias("key"), F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    counts = cut_lineage(word_counts(docs.select("lang", "text")).filter((F.col("f") >= least) | F.col("word").isNull()), "words")
    totals = counts.filter("word is null").select("lang", F.col("f").alias("n"))
    words = cut_lineage(places.numbered(counts.filter("word is not null"), [], [F.col("lang"), F.col("word")], "id").withColumn("id", F.col("id") - 1), "numbers")
    size, total = words.count(), totals.agg(F.sum("n")).first()[0] or 0
    b = max(1, (size - 1).bit_length())
    shards = max(parallelism(spark), -(-total // SHARD_WORDS)).bit_length()
    filters, sent = local_filters(docs, words, size, b, shards, total, most)
    grams = cut_lineage(merged(filters, b, shards, least), "grams")
    if sent is not None:
        sent.destroy()
    one = words.select(F.col("id"), "word", F.col("f").alias("own"), "lang")

    def named(g: DataFrame, i: int) -> DataFrame:
        return g.join(one.select(F.col("id").alias(f"w{i}"), F.col("word").alias(f"word{i}"), F.col("own").alias(f"f{i}"), *([F.col("lang")] if i == 1 else [])), f"w{i}")

    two = grams.filter("w3 is null").select("w1", "w2", F.col("f").alias("a"))
    three = grams.filter("w3 is not null").select("w1", "w2", "w3", F.col("f").alias("a"))
    longer = three.select("w1", "w2", "a").unionByName(three.select(F.col("w2").alias("w1"), F.col("w3").alias("w2"), "a")).groupBy("w1", "w2").agg(F.max("a").alias("longest"))
    left2 = two.join(longer, ["w1", "w2"], "left").filter("longest is null or 2 * longest < a").drop("longest")
    pairs = named(named(left2, 1), 2).select("lang", F.concat_ws(" ", "word1", "word2").alias("phrase"), "a", F.col("f1").alias("l"), F.col("f2").alias("r"), score(F.col("a"), F.col("f1"), F.col("f2")).alias("score"))
    triples = named(named(three, 1), 3).join(one.select(F.col("id").alias("w2"), F.col("word").alias("word2")), "w2")
    triples = triples.join(two.select("w1", "w2", F.col("a").alias("f12")), ["w1", "w2"]).join(two.select(F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("f23")), ["w2", "w3"])
    triples = triples.withColumn("s1", score(F.col("a"), F.col("f1"), F.col("f23"))).withColumn("s2", score(F.col("a"), F.col("f12"), F.col("f3")))
    first = F.col("s1") <= F.col("s2")
    triples = triples.select("lang", F.concat_ws(" ", "word1", "word2", "word3").alias("phrase"), "a", F.when(first, F.col("f1")).otherwise(F.col("f12")).alias("l"), F.when(first, F.col("f23")).otherwise(F.col("f3")).alias("r"), F.least("s1", "s2").alias("score"))
    best = pairs.unionByName(triples).withColumn("part", F.pmod(F.hash("phrase"), F.lit(PARTS)))
    for by in (["lang", "part"], ["lang"]):
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), F.desc("a"), "phrase"))).filter(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))
