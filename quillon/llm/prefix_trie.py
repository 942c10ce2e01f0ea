"""Trie of conversation prefixes with totals of every subtree, by time-forward processing.

A conversation is a sequence of turns (role, text); each distinct sequence of first d turns is a node of depth d. A node is known by 120 bits: the exclusive or, over its turns, of hashes of depth, role and text. Such keys can be carried from one slice of a conversation to the next, so no conversation has to lie in one task. Texts are read once, for their hashes and lengths.

A node whose members have more turns below it than a bound is heavy; the bound is the turns of all conversations by the number of shards wanted. The other nodes form subtrees no larger than the bound under heavy parents: each is a shard. In a shard nodes are sorted by reverse level order, outside memory where need be (Spark's sort), and each node's totals wait for its parent in a priority queue that spills. Shard roots send theirs, summed by parent, to the heavy nodes.

Heavy nodes with one smallest member lie on one path, a chain. Chains are at most as many as there are shards' worth of turns, and they are processed forward in time in the same way, the latest first: each passes its total to the chain that it hangs on. The nodes of a chain then add up by running sums over slices, so long chains are no load on one task.

Defined cases: rows without conv_id belong to no conversation. Turns are ordered by number, null first; those of equal number by the hash of role and text. A null role or text is empty, so equal to an empty one. conv_id % 100 is taken as not negative. No conversations give no rows, not even a root. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import marshal
import os
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import Scratch, cut_lineage, map_arrow, parallelism, table
from quillon.operators import places

#: Least number of turns below a heavy node. With more turns it is such that a shuffle partition gets SHARDS shards, and chains number no more than shards.
SHARD, SHARDS = 512, 16
#: Messages that a queue holds in memory.
QUEUE = 1 << 15
#: conv_ids that are joined to one piece before a node's are hashed.
PIECE = 4096
KEY = ["depth", "k1", "k2"]
UP = ["p1", "p2"]  # the parent's key, one level up


class SpillingQueue:
    """A priority queue of tuples, smallest first. Beyond limit tuples, those in memory go to a file as a sorted run; the file has no name and goes with the task."""

    def __init__(self, limit: int = QUEUE):
        self.limit, self.heap, self.runs = max(1, limit), [], []

    def push(self, item: tuple) -> None:
        heapq.heappush(self.heap, item)
        if len(self.heap) > self.limit:
            self.heap.sort()
            run = self._run(self.heap)
            heapq.heappush(self.runs, (next(run), len(self.runs), run))
            self.heap = []

    def _run(self, items: list[tuple]) -> Iterator[tuple]:
        step = max(1, self.limit // 64)
        file = tempfile.TemporaryFile(dir=os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None)
        for i in range(0, len(items), step):
            marshal.dump(items[i : i + step], file)
        file.seek(0)

        def read() -> Iterator[tuple]:
            with file:
                for _ in range(0, n, step):
                    yield from marshal.load(file)

        n = len(items)
        return read()

    def first(self) -> tuple | None:
        if self.runs and (not self.heap or self.runs[0][0] < self.heap[0]):
            return self.runs[0][0]
        return self.heap[0] if self.heap else None

    def pop(self) -> tuple:
        if self.runs and (not self.heap or self.runs[0][0] < self.heap[0]):
            item, n, run = self.runs[0]
            if (then := next(run, None)) is None:
                heapq.heappop(self.runs)
            else:
                heapq.heapreplace(self.runs, (then, n, run))
            return item
        return heapq.heappop(self.heap)


def _hash(text: Column) -> tuple[Column, Column]:
    """120 bits as two numbers that aren't negative."""
    h = F.md5(text.cast("binary"))
    return tuple(F.conv(F.substring(h, at, 15), 16, 10).cast("long") for at in (1, 16))


def _turn_hash(depth: Column, turn: Column) -> tuple[Column, Column]:
    return _hash(F.concat_ws(":", depth.cast("string"), turn))


def _xor_of(turns: Column | str, field: str) -> Column:
    return F.aggregate(turns, F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x[field]))


def turns(conversations: DataFrame) -> DataFrame:
    """(c, turn, t, chars): a row a turn, t the hash of role and text, chars the text's length."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    own = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("c"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    return own.select("c", "turn", F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")).alias("t"), F.length("text").cast("long").alias("chars"))


def head_length(c: Column) -> Column:
    return (F.crc32(c.cast("string").cast("binary")) % 6).cast("long")


def rebuilt(conversations: DataFrame, cut: Callable[[DataFrame, str], DataFrame] = cut_lineage) -> tuple[DataFrame, DataFrame]:
    """(c, len) of every conversation and (c, len, depth, k1, k2, p1, p2, chars) of every prefix but the empty one: the first turns of the conversation whose id is the next lower multiple of 100, then its own."""
    all_ = cut(turns(conversations), "turns")
    own = cut(places.numbered(all_, ["c"], [F.col("turn"), F.col("t")], "place"), "numbered")
    sizes = own.groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    base = own.filter("pmod(c, 100) = 0 and place <= 5").groupBy(F.col("c").alias("base")).agg(F.array_sort(F.collect_list(F.struct("place", "t", "chars"))).alias("turns"))
    h = head_length(F.col("c"))
    info = sizes.withColumn("h", h).withColumn("base", F.expr("c - pmod(c, 100)")).join(base, "base", "left")
    info = info.withColumn("head", F.slice(F.coalesce("turns", F.expr("filter(array(struct(0L as place, '' as t, 0L as chars)), x -> false)")), F.lit(1), F.col("h").cast("int")))

    def prefix(x: Column) -> Column:
        k1, k2 = _turn_hash(x["place"], x["t"])
        return F.struct(x["place"].alias("depth"), k1.alias("e1"), k2.alias("e2"), x["chars"].alias("chars"))

    info = info.withColumn("head", F.transform("head", prefix))
    info = info.withColumn("len", F.size("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    total = {k: _xor_of("head", k) for k in ("e1", "e2")}
    info = cut(info.select("c", "len", "head", F.size("head").cast("long").alias("from"), total["e1"].alias("f1"), total["e2"].alias("f2")), "heads")

    part = {f"k{i}": _xor_of(F.slice("head", F.lit(1), F.col("x.depth").cast("int")), f"e{i}").alias(f"k{i}") for i in (1, 2)}
    heads = info.select("c", "len", "head", F.explode("head").alias("x")).select("c", "len", "x.depth", part["k1"], part["k2"], "x.e1", "x.e2", "x.chars")
    later = own.filter(F.col("place") > h).join(info.select("c", "len", "from", "f1", "f2"), "c").withColumn("depth", F.col("from") + F.col("place") - h)
    e1, e2 = _turn_hash(F.col("depth"), F.col("t"))
    later = cut(later.select("c", "len", "depth", "f1", "f2", e1.alias("e1"), e2.alias("e2"), "chars"), "later")
    later = places.running(later, ["c"], [F.col("depth")], {"r1": F.col("e1"), "r2": F.col("e2")}, "xor")
    later = later.select("c", "len", "depth", F.col("f1").bitwiseXOR(F.col("r1")).alias("k1"), F.col("f2").bitwiseXOR(F.col("r2")).alias("k2"), "e1", "e2", "chars")
    every = heads.unionByName(later)
    return info.select("c", "len"), every.select("c", "len", *KEY, *[F.col(f"k{i}").bitwiseXOR(F.col(f"e{i}")).alias(f"p{i}") for i in (1, 2)], "chars")


def _members(sizes: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(depth, k1, k2, p1, p2, chars, n, c, below): a row a node with its members, their smallest id and the turns that they have below it."""
    figures = [F.count(F.lit(1)).alias("n"), F.min("c").alias("c"), F.sum(F.col("len") - F.col("depth")).alias("below")]
    nodes = prefixes.groupBy(*KEY, *UP, "chars").agg(*figures)  # the key decides the parent and the length
    zero = F.lit(0).cast("long")
    root = sizes.withColumn("depth", zero).agg(*figures).filter("n > 0").select(*(zero.alias(k) for k in KEY), *(F.lit(None).cast("long").alias(p) for p in UP), zero.alias("chars"), "n", "c", "below")
    return root.unionByName(nodes.select(*root.columns))


def _forward(df: DataFrame) -> DataFrame:
    """Totals of the nodes of shards. df: (r0, r1, r2: the shard's root, depth, k1, k2, p1, p2, chars, n, c), sorted by root, then by reverse level order."""
    names = [*KEY, *UP, "chars", "n", "c", "n_children", "n_leaves", "saved", "is_root"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue = SpillingQueue()
        for b in batches:
            got = {k: b.column(b.schema.get_field_index(k)).to_pylist() for k in ("r0", "r1", "r2", *KEY, *UP, "chars", "n", "c")}
            out = ([], [], [], [])
            for r0, r1, r2, d, k1, k2, p1, p2, chars, n in zip(*(got[k] for k in ("r0", "r1", "r2", *KEY, *UP, "chars", "n")), strict=True):
                children, leaves, saved, at = 0, 0, (n - 1) * chars, (-d, k1, k2)
                while (m := queue.first()) is not None and m[:3] == at:
                    m = queue.pop()
                    children, leaves, saved = children + 1, leaves + m[3], saved + m[4]
                leaves = leaves or 1
                top = (r0, r1, r2) == (d, k1, k2)
                if not top:
                    queue.push((1 - d, p1, p2, leaves, saved))
                for o, v in zip(out, (children, leaves, saved, top), strict=True):
                    o.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(got[k], pa.int64()) for k in (*KEY, *UP, "chars", "n", "c")] + [pa.array(o, pa.int64()) for o in out[:3]] + [pa.array(out[3], pa.bool_())], names)

    return map_arrow(df, run, ", ".join(f"{k} long" for k in names[:-1]) + ", is_root boolean")


def _chains_forward(chains: DataFrame) -> DataFrame:
    """(up0, up1, up2, leaves, saved): what each chain's subtree passes to the node that it hangs on. chains: (c, up_c, up0, up1, up2, leaves, saved), a row a chain, the latest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue = SpillingQueue()
        for b in batches:
            c, up_c, u0, u1, u2, leaves, saved = (x.to_pylist() for x in b.columns)
            for i in range(b.num_rows):
                while (m := queue.first()) is not None and m[0] == -c[i]:
                    m = queue.pop()
                    leaves[i], saved[i] = leaves[i] + m[1], saved[i] + m[2]
                if up_c[i] is not None:
                    queue.push((-up_c[i], leaves[i], saved[i]))
            yield pa.RecordBatch.from_arrays([*b.columns[2:5], pa.array(leaves, pa.int64()), pa.array(saved, pa.int64())], ["up0", "up1", "up2", "leaves", "saved"])

    return map_arrow(chains, run, "up0 long, up1 long, up2 long, leaves long, saved long")


def _sums(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("m"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def _heavy_totals(heavy: DataFrame, shards: DataFrame, cut: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """Heavy nodes with their totals. shards: the totals of all nodes in shards."""
    up = {"up0": F.col("depth") - 1, "up1": F.col("p1"), "up2": F.col("p2")}
    sent = _sums(shards.filter("is_root").select(*[c.alias(n) for n, c in up.items()], F.col("n_leaves").alias("leaves"), "saved"), *up)
    on = {"depth": "up0", "k1": "up1", "k2": "up2"}

    def received(nodes: DataFrame, messages: DataFrame, name: str) -> DataFrame:
        m = messages.select(*[F.col(v).alias(k) for k, v in on.items()], *[F.col(x).alias(f"{name}_{x}") for x in ("m", "leaves", "saved")])
        out = nodes.join(m, KEY, "left")
        return out.withColumns({f"{name}_{x}": F.coalesce(f"{name}_{x}", F.lit(0)) for x in ("m", "leaves", "saved")})

    own = received(heavy, sent, "s")
    below = heavy.filter("depth > 0").select(*[c.alias(n) for n, c in up.items()], F.lit(0).alias("leaves"), F.lit(0).alias("saved"))
    own = received(own, _sums(below, *up), "h").withColumn("n_children", F.col("s_m") + F.col("h_m"))
    own = own.withColumn("leaves", F.when(F.col("n_children") == 0, 1).otherwise(F.col("s_leaves")).cast("long")).withColumn("saved", (F.col("n") - 1) * F.col("chars") + F.col("s_saved"))
    own = cut(own.select(*heavy.columns, "n_children", "leaves", "saved"), "heavy")
    tops = own.groupBy("c").agg(F.min(F.struct("depth", *UP)).alias("top"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    tops = tops.select("c", (F.col("top.depth") - 1).alias("up0"), F.col("top.p1").alias("up1"), F.col("top.p2").alias("up2"), "leaves", "saved")
    of = own.select(F.col("depth").alias("up0"), F.col("k1").alias("up1"), F.col("k2").alias("up2"), F.col("c").alias("up_c"))
    chains = tops.join(of, list(up), "left").select("c", "up_c", *up, "leaves", "saved")
    passed = _sums(_chains_forward(chains.repartition(1).sortWithinPartitions(F.desc("c"))).filter("up1 is not null"), *up)  # a row a chain
    nodes = cut(received(own, passed, "c"), "hung")
    done = places.running(nodes, ["c"], [F.col("depth")], {"n_leaves": F.col("leaves") + F.col("c_leaves"), "total": F.col("saved") + F.col("c_saved")}, back=True)
    return done.select(*KEY, *UP, "chars", "n", "c", "n_children", "n_leaves", F.col("total").alias("saved"))


def _digests(sizes: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends_sha256) of nodes where conversations end: the hash of their ids, ascending. Ids are joined to pieces before they meet in a task."""
    zero = F.lit(0).cast("long")
    ends = prefixes.filter("depth = len").select("c", *KEY).unionByName(sizes.filter("len = 0").select("c", *(zero.alias(k) for k in KEY)))
    ids = F.transform(F.array_sort(F.collect_list("c")), lambda x: x.cast("string"))
    pieces = ends.groupBy(*KEY, F.expr(f"floor(c / {PIECE}D)").alias("piece")).agg(F.array_join(ids, ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for b in batches:
            out = []
            for d, k1, k2, ids in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if (d, k1, k2) == key:
                    state.update(b"," + ids.encode())
                    continue
                if key is not None:
                    out.append((*key, state.hexdigest()))
                key, state = (d, k1, k2), hashlib.sha256(ids.encode())
            yield _digest_batch(out)
        if key is not None:
            yield _digest_batch([(*key, state.hexdigest())])

    dealt = pieces.repartition(parallelism(sizes.sparkSession), *KEY).sortWithinPartitions(*KEY, "piece").select(*KEY, "ids")
    return map_arrow(dealt, run, ", ".join(f"{k} long" for k in KEY) + ", ends_sha256 string")


def _digest_batch(rows: list[tuple]) -> pa.RecordBatch:
    d, k1, k2, s = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(s, pa.string())], [*KEY, "ends_sha256"])


def trie(conversations: DataFrame, shard: int | None = None) -> DataFrame:
    """A row a node: its smallest member, depth, key and parent's key, members, children, leaves, what sharing it and its subtree saves, and the hash of the conversations that end there."""
    with Scratch(conversations.sparkSession) as scratch:
        cut = scratch.cut
        sizes, prefixes = rebuilt(conversations, cut)
        prefixes = cut(prefixes, "prefixes")
        nodes = cut(_members(sizes, prefixes), "nodes")
        if shard is None:
            root = nodes.filter("depth = 0").first()
            shard = max(SHARD, (root.below if root else 0) // (SHARDS * parallelism(conversations.sparkSession)))
        is_heavy = (F.col("below") > shard) | (F.col("depth") == 0)
        heavy = cut(nodes.filter(is_heavy).drop("below"), "heavy")
        light = nodes.filter(~is_heavy).drop("below")
        # the first light prefix of a conversation is the root of the shard of all its later ones
        first = prefixes.join(heavy.select(*KEY), KEY, "left_anti").groupBy("c").agg(F.min(F.struct(*KEY)).alias("r")).select("c", F.col("r.depth").alias("r0"), F.col("r.k1").alias("r1"), F.col("r.k2").alias("r2"))
        dealt = light.join(first, "c").select("r0", "r1", "r2", *KEY, *UP, "chars", "n", "c")
        dealt = dealt.repartition(parallelism(conversations.sparkSession), "r1", "r2").sortWithinPartitions("r0", "r1", "r2", F.desc("depth"), "k1", "k2")
        shards = cut(_forward(dealt), "shards")
        all_ = cut_lineage(shards.drop("is_root").unionByName(_heavy_totals(heavy, shards, cut)), "totals")
        digests = cut_lineage(_digests(sizes, prefixes), "digests")
    parents = all_.filter("n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("c").alias("parent_conv_id"))
    out = all_.join(parents, ["depth", *UP], "left").join(digests, KEY, "left")
    return out.select(
        F.col("c").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), "n_children", "n_leaves", F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"), *["k1", "k2", *UP],
    )


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(table(spark, sf_dir, "conversations")).drop("k1", "k2", *UP)
