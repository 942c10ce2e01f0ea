"""Hierarchical budgeting of a token total over a domain-language-source tree.

Every node's budget is dealt to its children by weight, filling up those whose supply (tokens times the epochs allowed) is short; what they lack goes to their siblings by weight, and only what a whole subtree lacks reaches the siblings of its ancestor. A leaf gives whole epochs of its documents and then a token-prefix of one more, in the order that the seed and the epoch's number give its documents.

Built-in functions only. Tokens are counted once, into a narrow table. The prefix of a leaf is one document, its last, that a descent by digits of the order finds: sums of the slices of a leaf, then of the slice that holds the budget's end, and so on, so no task holds a leaf and each step reads a part of the one before. With its place in the order every row of the texts tells by itself whether it is selected: texts are never shuffled.

Defined cases: tokens are words [^\\x20\\x09-\\x0D]+ of the whole text, however long; null and empty texts have none and are never selected. A null domain, language or source is the node 'none'. A node of weight 0 gets nothing. Budgets above the supply of all epochs are cut to it. Rows with the same id follow each other by length and a hash of the text; rows equal in these are interchangeable. An empty table gives no rows. Input columns with the names of the added ones are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm.common import Scratch, cut_lineage, table

#: Rows of the leaf table that are broadcast at most (some 200 bytes each); more are joined by shuffle.
BROADCAST_LEAVES = 20_000
#: Hexadecimal digits of the order that each step of the descent tells apart, and its steps: leaves of 2^31 documents end in slices of some 100.
DIGITS, STEPS = 2, 3
#: Parts that equal rows at the end of a prefix are numbered in.
SALTS = 64
WORD = "[^\\\\x20\\\\x09-\\\\x0D]+"
LEAF = ["domain", "language", "origin"]


@dataclass(frozen=True)
class Weights:
    """Integer weights of nodes by name; names that aren't listed weigh other."""

    domain: dict[str, int] = field(default_factory=lambda: {"d0": 4, "d1": 3, "d2": 2, "d3": 1})
    language: dict[str, int] = field(default_factory=lambda: {"en": 6, "de": 2, "fr": 2})
    origin: dict[str, int] = field(default_factory=dict)
    other: int = 1

    def column(self, level: str) -> Column:
        out = F.lit(self.other)
        for k, w in getattr(self, level).items():
            out = F.when(F.col(level) == F.lit(k), w).otherwise(out)
        return out

    def sql(self, level: str) -> str:
        cases = " ".join("when {} = '{}' then {}".format(level, k.replace("'", "''"), w) for k, w in getattr(self, level).items())
        return f"case {cases} else {self.other} end" if cases else str(self.other)


#: The tables have no domain: the number that ends a source's name, modulo 4, stands for one.
DOMAIN = "coalesce(concat('d', cast(try_cast(regexp_extract(source, '([0-9]+)$', 1) as bigint) % 4 as string)), 'none')"


def fill(nodes: DataFrame, parent: list[str], name: str, weight: Column) -> DataFrame:
    """nodes (parent..., name, cap, total) with budget: each parent's total dealt to its children by weight up to their caps. Saturated are the first in order of cap / weight as long as their cap is within what is left by weight."""
    big = "decimal(38,0)"
    nodes = nodes.withColumn("w", weight.cast(big)).withColumn("cap", F.col("cap").cast(big))
    order = Window.partitionBy(*parent).orderBy(F.coalesce(F.try_divide("cap", "w").cast("double"), F.lit(0.0)), name)
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    nodes = nodes.withColumn("spent", F.coalesce(F.sum("cap").over(before), F.lit(0)).cast(big)).withColumn("weigh", F.sum("w").over(rest).cast(big))
    nodes = nodes.withColumn("short", F.expr(f"cast(cap * weigh as {big}) <= cast(w * (total - spent) as {big})"))
    whole = Window.partitionBy(*parent)
    left = (F.col("total") - F.coalesce(F.sum(F.when(F.col("short"), F.col("cap"))).over(whole), F.lit(0))).cast(big)
    open_w = F.when(F.col("short"), F.lit(0)).otherwise(F.col("w")).cast(big)
    nodes = nodes.withColumn("left_", left).withColumn("upto", F.sum(open_w).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast(big)).withColumn("open", F.sum(open_w).over(whole).cast(big))
    share = F.expr(f"(cast(left_ * upto as {big}) div nullif(open, 0)) - (cast(left_ * (upto - w) as {big}) div nullif(open, 0))")
    return nodes.withColumn("budget", F.when(F.col("short"), F.col("cap")).otherwise(share).cast("long")).select(*parent, name, "budget")


def budgets(supply: DataFrame, total: int | None, share: float, epochs: int, weights: Weights) -> DataFrame:
    """(domain, language, origin, tokens, budget) of every leaf of (domain, language, origin, tokens)."""
    weighed = F.least(*[weights.column(level) for level in LEAF]) > 0
    caps = supply.withColumn("cap", F.when(weighed, F.col("tokens") * epochs).otherwise(0))
    by_domain = caps.groupBy("domain").agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens"))
    everything = Window.partitionBy()
    want = F.floor(F.sum("tokens").over(everything) * F.lit(share).cast("decimal(9,6)")).cast("long") if total is None else F.lit(total).cast("long")
    by_domain = by_domain.withColumn("total", F.least(want, F.sum("cap").over(everything)))
    d = fill(by_domain, [], "domain", weights.column("domain"))
    by_language = caps.groupBy("domain", "language").agg(F.sum("cap").alias("cap")).join(d.withColumnRenamed("budget", "total"), "domain")
    by_language = fill(by_language, ["domain"], "language", weights.column("language"))
    leaves = caps.join(by_language.withColumnRenamed("budget", "total"), ["domain", "language"])
    return fill(leaves, ["domain", "language"], "origin", weights.column("origin")).join(supply, LEAF)


def _count(text: str) -> Column:
    return F.coalesce(F.expr(f"regexp_count({text}, '{WORD}')"), F.lit(0)).cast("long")


def _order(seed: int, epoch: str, doc_id: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), epoch, F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).cast("binary"))


def _with_leaf(rows: DataFrame, leaf: DataFrame, few: bool) -> DataFrame:
    return rows.join(F.broadcast(leaf) if few else leaf, LEAF)


def _last(part: DataFrame, leaf: DataFrame, few: bool, steps: Scratch) -> DataFrame:
    """leaf with the document at which its prefix ends: (order_, id_, tokens_, text_) and end_ of its tokens (null: all) after ends_ rows that equal it; all null where a leaf has no prefix. part: (leaf, order_, id_, tokens_, text_)."""
    at = leaf.filter("rest > 0").select(*LEAF, F.lit("").alias("head_"), F.col("rest").alias("left_"))
    for step in range(STEPS):
        near = _with_leaf(part, at, few).filter(F.col("order_").startswith(F.col("head_")))
        if step:
            near = part = steps.cut(near.select(*part.columns), "slice")
            near = _with_leaf(near, at, few)
        sums = near.groupBy(*LEAF, "left_", F.substring("order_", 1, (step + 1) * DIGITS).alias("head_")).agg(F.sum("tokens_").alias("own_"))
        ahead = F.coalesce(F.sum("own_").over(Window.partitionBy(*LEAF).orderBy("head_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # of a leaf's few slices
        sums = sums.withColumn("left_", F.col("left_") - ahead).filter("left_ > 0 and left_ <= own_")
        at = steps.cut(sums.select(*LEAF, "head_", "left_"), "heads")
    near = _with_leaf(part, at, few).filter(F.col("order_").startswith(F.col("head_")))
    keys = near.groupBy(*LEAF, "left_", "order_", "id_", "tokens_", "text_").agg(F.count(F.lit(1)).alias("copies_"))
    line = Window.partitionBy(*LEAF).orderBy("order_", "id_", "tokens_", "text_").rowsBetween(Window.unboundedPreceding, -1)
    keys = keys.withColumn("left_", F.col("left_") - F.coalesce(F.sum(F.col("tokens_") * F.col("copies_")).over(line), F.lit(0))).filter("left_ > 0 and left_ <= tokens_ * copies_")
    whole = F.expr("(left_ - 1) div tokens_")
    found = keys.select(*LEAF, "order_", "id_", "tokens_", "text_", "copies_", whole.alias("ends_"), F.nullif(F.col("left_") - whole * F.col("tokens_"), F.col("tokens_")).alias("end_"))
    return leaf.join(found, LEAF, "left")


def _chosen(rows: DataFrame, leaf: DataFrame, few: bool, seed: int, tokens: Column, text_hash: Column) -> DataFrame:
    """(row, domain, language, origin, epoch, cut) of rows (row, doc_id, domain, language, origin): the whole epochs of each and, by its place before, at or behind its leaf's last document, its part of one more. cut: the number of its first tokens, null for all. tokens and text_hash are only looked at in rows with the order of the last document."""
    own = _with_leaf(rows, leaf, few)
    order = _order(seed, "whole", "doc_id")
    key, last = F.struct(order.alias("order_"), F.col("doc_id").alias("id_")), F.struct("order_", "id_")
    detail, last_detail = F.struct(tokens.alias("tokens_"), text_hash.alias("text_")), F.struct("tokens_", "text_")
    place = F.when(F.col("order_").isNull() | (key > last), 1).when(key < last, -1).when(detail < last_detail, -1).when(detail > last_detail, 1).otherwise(0)
    own = own.withColumn("place_", place)
    more = (F.col("place_") < 0) | (F.col("place_") == 0) & (F.col("copies_") == 1)
    epochs = F.col("whole") - F.when(more, 0).otherwise(1)
    out = own.withColumn("epochs_", epochs).filter("epochs_ >= 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("epochs_"))))
    out = out.select("row", *LEAF, "epoch", F.when((F.col("epoch") == F.col("whole")) & (F.col("place_") == 0), F.col("end_")).alias("cut"))
    if leaf.filter("copies_ > 1").isEmpty():
        return out
    # rows equal to the last: numbered in parts, which a written column of random numbers gives
    tied = cut_lineage(own.filter("place_ = 0 and copies_ > 1").withColumn("salt_", F.floor(F.rand() * SALTS).cast("int")), "tied")
    sums = tied.groupBy(*LEAF, "salt_").agg(F.count(F.lit(1)).alias("n_"))
    sums = sums.withColumn("ahead_", F.coalesce(F.sum("n_").over(Window.partitionBy(*LEAF).orderBy("salt_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n_")
    tied = tied.join(sums, [*LEAF, "salt_"]).withColumn("number_", F.col("ahead_") + F.row_number().over(Window.partitionBy(*LEAF, "salt_").orderBy("doc_id")) - 1)
    tied = tied.filter("number_ <= ends_").withColumn("epoch", F.col("whole"))
    return out.unionByName(tied.select("row", *LEAF, "epoch", F.when(F.col("number_") == F.col("ends_"), F.col("end_")).alias("cut")))


def _selected(docs: DataFrame, total: int | None, share: float, epochs: int, seed: int, weights: Weights, domain: str, texts: bool = True) -> DataFrame:
    """_chosen with docs' columns as the struct row; without texts, the narrow table's id and n_tokens."""

    def named(c: str) -> Column:
        return F.coalesce(F.expr(c), F.lit("none"))

    nodes = [named(c).alias(n) for c, n in zip((domain, "lang", "source"), LEAF, strict=True)]
    narrow = docs.select("doc_id", *nodes, _count("text").alias("n_tokens"), F.xxhash64("text").alias("text_hash")).filter("n_tokens > 0")
    narrow = cut_lineage(narrow, "counted")
    with Scratch(docs.sparkSession) as steps:
        supply = steps.cut(narrow.groupBy(*LEAF).agg(F.sum("n_tokens").alias("tokens")), "supply")
        few = supply.count() <= BROADCAST_LEAVES
        leaf = budgets(supply, total, share, epochs, weights).select(*LEAF, F.expr("budget div tokens").cast("int").alias("whole"), F.expr("budget % tokens").alias("rest"))
        leaf = steps.cut(leaf, "budgets")
        part = _with_leaf(narrow, leaf.filter("rest > 0"), few)
        part = part.select(*LEAF, _order(seed, "whole", "doc_id").alias("order_"), F.col("doc_id").alias("id_"), F.col("n_tokens").alias("tokens_"), F.col("text_hash").alias("text_"))
        leaf = cut_lineage(_last(part, leaf, few, steps), "leaves")
    if not texts:
        return _chosen(narrow.select(F.struct("doc_id", "n_tokens").alias("row"), "doc_id", *LEAF, "n_tokens", "text_hash"), leaf, few, seed, F.col("n_tokens"), F.col("text_hash"))
    rows = docs.filter(F.expr(f"text rlike '{WORD}'")).select(F.struct(*docs.columns).alias("row"), "doc_id", *nodes)
    return _chosen(rows, leaf, few, seed, _count("row.text"), F.xxhash64("row.text"))


def mix(docs: DataFrame, total: int | None = None, share: float = 1.0, epochs: int = 3, seed: int = 17, weights: Weights = Weights(), domain: str = DOMAIN) -> DataFrame:
    """docs' columns with domain, language, origin, n_tokens, epoch and take: a row for each epoch that selects the document; take is the number of its first tokens. total: tokens to select, else share times the supply."""
    added = [*LEAF, "n_tokens", "epoch", "take"]
    out = _selected(docs, total, share, epochs, seed, weights, domain).withColumn("n_tokens", _count("row.text"))
    out = out.withColumn("take", F.coalesce("cut", "n_tokens"))
    return out.select(*[F.col("row")[c].alias(c) for c in docs.columns if c.lower() not in added], *added)


def mixed_documents(docs: DataFrame, total: int | None = None, share: float = 1.0, epochs: int = 3, seed: int = 17, weights: Weights = Weights(), domain: str = DOMAIN) -> DataFrame:
    """The selected documents with docs' own columns, a row for each epoch; a cut text is its first words joined by a space, and n_chars its length."""
    out = _selected(docs, total, share, epochs, seed, weights, domain)
    cut = F.expr(f"array_join(slice(regexp_extract_all(row.text, '{WORD}', 0), 1, cast(cut as int)), ' ')")
    out = out.withColumn("text_", F.when(F.col("cut").isNotNull(), cut).otherwise(F.col("row.text")))
    own = {"text": F.col("text_"), "n_chars": F.length("text_")}
    return out.select(*[own.get(f.name, F.col("row")[f.name]).cast(f.dataType).alias(f.name) for f in docs.schema])


def op5_hierarchical_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    out = _selected(docs, None, 1.0, 3, 17, Weights(), DOMAIN, texts=False)
    return out.select("row.doc_id", *LEAF, "epoch", "row.n_tokens", F.coalesce("cut", "row.n_tokens").alias("take"))


def _fill_sql(name: str, source: str, parent: str, label: str, weight: str) -> str:
    """One level of the tree as common table expressions that end in `name`."""
    part = f"partition by {parent}" if parent else ""
    keys = f"{parent}, {label}" if parent else label
    return f"""
{name}_w as (select *, cast({weight} as hugeint) as w from {source}),
{name}_o as (select *, coalesce(sum(cap) over (o rows between unbounded preceding and 1 preceding), 0) as spent,
    sum(w) over (o rows between current row and unbounded following) as weigh
  from {name}_w window o as ({part} order by cap / cast(w as double), {label})),
{name}_s as (select *, cap * weigh <= w * (total - spent) as short from {name}_o),
{name}_l as (select *, total - coalesce(sum(case when short then cap end) over ({part}), 0) as left_,
    sum(case when short then 0 else w end) over ({part} order by cap / cast(w as double), {label} rows unbounded preceding) as upto,
    sum(case when short then 0 else w end) over ({part}) as open_w from {name}_s),
{name} as (select {keys}, cast(case when short then cap else left_ * upto // open_w - left_ * (upto - w) // open_w end as bigint) as budget from {name}_l)"""


def oracle() -> str:
    w = Weights()
    return f"""
with d as (select doc_id, coalesce('d' || cast(try_cast(regexp_extract(source, '([0-9]+)$', 1) as bigint) % 4 as varchar), 'none') as domain,
    coalesce(lang, 'none') as language, coalesce(source, 'none') as origin,
    cast(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) as bigint) as n_tokens from documents),
supply as (select domain, language, origin, cast(sum(n_tokens) as hugeint) as tokens, cast(sum(n_tokens) * 3 as hugeint) as cap from d group by all having sum(n_tokens) > 0),
top as (select domain, sum(cap) as cap, least(sum(sum(tokens)) over (), sum(sum(cap)) over ()) as total from supply group by domain),
{_fill_sql("bd", "top", "", "domain", w.sql("domain"))},
mid as (select domain, language, sum(cap) as cap, any_value(budget) as total from supply join bd using (domain) group by domain, language),
{_fill_sql("bl", "mid", "domain", "language", w.sql("language"))},
low as (select supply.*, budget as total from supply join bl using (domain, language)),
{_fill_sql("bo", "low", "domain, language", "origin", w.sql("origin"))},
leaf as (select bo.*, cast(budget // tokens as bigint) as whole, cast(budget % tokens as bigint) as rest from bo join supply using (domain, language, origin)),
r as (select d.*, whole, rest, unnest(generate_series(0, whole)) as epoch from d join leaf using (domain, language, origin) where n_tokens > 0),
p as (select *, rest - coalesce(sum(n_tokens) over (partition by domain, language, origin order by md5('17|' || epoch || '|' || coalesce(cast(doc_id as varchar), '')), doc_id, n_tokens
    rows between unbounded preceding and 1 preceding), 0) as have from r where epoch = whole and rest > 0)
select doc_id, domain, language, origin, cast(epoch as integer) as epoch, n_tokens, n_tokens as take from r where epoch < whole
union all
select doc_id, domain, language, origin, cast(epoch as integer), n_tokens, cast(least(n_tokens, have) as bigint) from p where have > 0"""
