"""Exact dedup by 128-bit content hashes, with bytes compared inside groups; DataFrame functions only.

Each text is read into a narrow row (hash, SHA-256, id), which is all that is grouped: texts are not shuffled for that. Where a hash comes more than once, the bytes are compared: distinct pairs of hash and text are counted by hash, copies being combined inside a map step, so a text that a third of all rows hold travels once a step. If no more than BROADCAST_HASHES hashes come more than once, the scan leaves out the texts of all others before the shuffle; beyond that all texts take part, with the same result. A hash with two texts is a clash; its rows are grouped by the text itself.

Rows of one id and text are counted together first. The join that gives every row its group's figures has the rows on one side alone and a row a group on the other, so a hot group is split by adaptive execution.

Defined cases: a null text is empty. A null id is smaller than any other; a group of null ids alone stays by one of them. Of rows that agree in id and text one stays, in distinct_documents the one whose row hashes lowest. No rows give none. Other columns are ignored, whatever their names; distinct_documents returns them as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from quillon.llm.common import cut_lineage, table

#: Most hashes that are broadcast to the scan: some 60 bytes each.
BROADCAST_HASHES = 500_000
#: Rows of one id and text that are written out by one step of a sequence.
BLOCK = 10_000


def content_hash(text: Column) -> Column:
    """128 bits."""
    return F.unhex(F.md5(text.cast("binary")))


def _texts(docs: DataFrame, id_col: str, text_col: str, hash_: Callable[[Column], Column]) -> DataFrame:
    """(doc_id, h, text)."""
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return named.select("doc_id", hash_(F.col("text")).alias("h"), "text")


def _sha(text: str) -> Column:
    return F.unhex(F.sha2(F.col(text).cast("binary"), 256))


def clashes(texts: DataFrame, repeated: DataFrame, most: int = BROADCAST_HASHES) -> DataFrame:
    """(h) of hashes that two texts share. repeated: the hashes of more rows than one."""
    some = texts.select("h", "text")
    if repeated.limit(most + 1).count() <= most:
        some = some.join(F.broadcast(repeated), "h", "left_semi")
    return some.distinct().groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h")


def members(docs: DataFrame, id_col: str, text_col: str, keep: str, hash_: Callable[[Column], Column], most: int) -> DataFrame:
    """(h, doc_id, sha, m, keep_id, group_size): a row for each id and text, m rows of which there are."""
    if keep not in ("smallest", "largest"):
        raise ValueError("the smallest or the largest id stays")
    texts = _texts(docs, id_col, text_col, hash_)
    rows = cut_lineage(texts.select("doc_id", "h", _sha("text").alias("sha")), "hashes")
    repeated = cut_lineage(rows.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h"), "repeated")
    clash = cut_lineage(clashes(texts, repeated, most), "clashes")  # no rows unless a hash fails
    plain = rows.join(clash, "h", "left_anti").select("doc_id", "h", "sha", F.lit("").alias("own"))
    apart = texts.join(clash, "h", "left_semi").select("doc_id", "h", _sha("text").alias("sha"), F.concat(F.lit("="), "text").alias("own"))
    one = plain.unionByName(apart).groupBy("h", "own", "sha", "doc_id").agg(F.count(F.lit(1)).alias("m"))
    best = F.max("doc_id") if keep == "largest" else F.min("doc_id")
    groups = cut_lineage(one.groupBy("h", "own").agg(F.sum("m").alias("group_size"), best.alias("keep_id"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).filter("group_size > 1"), "groups")
    if keep == "smallest":  # null comes first
        groups = groups.withColumn("keep_id", F.when(F.col("nulls") == 0, F.col("keep_id")))
    got = one.join(groups.withColumn("found", F.lit(True)), ["h", "own"], "left")
    return got.select("h", "doc_id", "sha", "m", F.when(F.col("found"), F.col("keep_id")).otherwise(F.col("doc_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"))


def duplicates(docs: DataFrame, keep: str = "smallest", id_col: str = "doc_id", text_col: str = "text", hash_: Callable[[Column], Column] = content_hash, most: int = BROADCAST_HASHES) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row."""
    m = members(docs, id_col, text_col, keep, hash_, most)
    blocks = m.withColumn("b", F.explode(F.expr(f"sequence(0L, (m - 1) div {BLOCK})")))
    each = blocks.withColumn("i", F.explode(F.expr(f"sequence(b * {BLOCK} + 1, least(m, (b + 1) * {BLOCK}))")))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("i") == 1)
    return each.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def distinct_documents(docs: DataFrame, keep: str = "smallest", id_col: str = "doc_id", text_col: str = "text", hash_: Callable[[Column], Column] = content_hash, most: int = BROADCAST_HASHES) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    m = members(docs, id_col, text_col, keep, hash_, most)
    stay = m.filter(F.col("doc_id").eqNullSafe(F.col("keep_id"))).select("sha", F.coalesce(F.col("doc_id"), F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("none"))
    id_, plain = F.col(id_col).cast("long"), [f.name for f in docs.schema if not isinstance(f.dataType, MapType)]
    rows = docs.select(F.struct("*").alias("row"), F.xxhash64(*plain).alias("tie"), F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256)).alias("sha"), F.coalesce(id_, F.lit(0)).alias("id"), id_.isNull().alias("none"))
    first = F.row_number().over(Window.partitionBy("sha", "id", "none").orderBy("tie"))
    return rows.join(stay, ["sha", "id", "none"], "left_semi").withColumn("place", first).filter("place = 1").select("row.*")


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return duplicates(table(spark, sf_dir, "documents"), "largest")
