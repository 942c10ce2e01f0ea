"""Links of a metric space inside cells: pivots, triangle-inequality windows, and components.

Members of a cell are tried against its pivots, those with most neighbours. What lies within the radius is linked to the pivot; two others can only be linked if their distances from the pivot differ by no more than the radius, and the rest of the cell joins again with more pivots, until it is known to be one component or has no pair left to try.

A cell's members are never gathered: pivots come from aggregates that are combined before the shuffle, and members meet the few pivots of their cell in a join, which Spark splits where a cell is large.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import Scratch, cut_lineage, remove

#: Up to so many ids are broadcast (8 bytes each, so 2 MB); more are joined by shuffle.
BROADCAST_IDS = 250_000
#: A cell has 1 pivot in the first pass and so many times more in each further one: few passes end any cell.
PIVOTS = 32
#: Parts of a cell that its pivots are first sought in.
SPLIT = 64


def contract(edges: DataFrame) -> DataFrame:
    """(v, root) of every vertex of the edges (a, b): root is the smallest vertex of its component. Each round hooks every vertex to its smallest neighbour and contracts the edges to the hooks."""
    with Scratch(edges.sparkSession) as steps:
        edges = steps.cut(edges.filter("a <> b").distinct(), "edges")
        roots = edges.select(F.col("a").alias("v"), F.col("b").alias("root")).limit(0)
        first = True
        while not edges.isEmpty():
            both = edges.select(F.col("a").alias("v"), "b").union(edges.select(F.col("b").alias("v"), F.col("a").alias("b")))
            up = steps.cut(both.groupBy("v").agg(F.least(F.col("v"), F.min("b")).alias("up")), "hooks")
            to = up.select(F.col("v").alias("root"), "up")
            roots = to.select(F.col("root").alias("v"), F.col("up").alias("root")) if first else roots.join(to, "root", "left").select("v", F.coalesce("up", "root").alias("root"))
            first = False
            a, b = up.select(F.col("v").alias("a"), F.col("up").alias("ra")), up.select(F.col("v").alias("b"), F.col("up").alias("rb"))
            # a hooked vertex keeps an edge to its hook until both have one root
            hooks = up.filter("v <> up").join(up.select(F.col("v").alias("up"), F.col("up").alias("next")), "up").select(F.col("up").alias("ra"), F.col("next").alias("rb"))
            edges = edges.join(a, "a").join(b, "b").select("ra", "rb").union(hooks).filter("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
            edges = steps.cut(edges, "edges")
        return cut_lineage(roots, "roots")


def few(ids: DataFrame) -> DataFrame:
    """ids, to be broadcast if a count finds few; many are joined by shuffle."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def linked(members: DataFrame, values: Callable[[DataFrame], DataFrame], measure: Callable[[str, str], tuple[Column, Column]], radius: float, may: Callable[[str, str], Column] = lambda m, p: F.lit(True), by_degree: bool = True) -> DataFrame:
    """(cls, comp) of every class of members (sig, cls, ...), cells with at least two classes. values: (cls, value) of the classes of a table (cls), called with those that a pass needs, so that no other is made or shuffled; measure: of two value columns, their distance and whether they are linked; may: whether two rows of members, by alias, can be linked. Pivots are those with most neighbours, or any."""
    columns = members.columns
    if by_degree:
        degree = members.groupBy("sig").agg(F.count("*").alias("n")).join(members, "sig").groupBy("cls").agg(F.sum("n").alias("degree"))
        left = members.join(degree, "cls")
    else:
        left = members.withColumn("degree", F.lit(0))
    left = left.withColumn("dist", F.lit(None).cast("double"))
    comp = cut_lineage(members.select("cls", F.col("cls").alias("comp")).distinct(), "components")
    step = 0
    old: DataFrame | None = None
    while True:
        with Scratch(members.sparkSession) as steps:
            m = left.join(comp, "cls") if step else left.withColumn("comp", F.col("cls"))
            several = m.groupBy("sig").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low <> high").select("sig")
            m = cut_lineage(m.join(several, "sig", "left_semi"), "cells")
            if old is not None:
                remove(old)
            if m.isEmpty():
                remove(m)
                return comp
            k = PIVOTS**step
            p = steps.cut(_first_ranks(m, k), "pivots")
            near = F.col("m.dist").isNull() | F.col("p.dist").isNull() | (F.abs(F.col("m.dist") - F.col("p.dist")) <= radius)
            pairs = m.alias("m").join(p.alias("p"), (F.col("m.sig") == F.col("p.sig")) & (F.col("p.cls") != F.col("m.cls")) & (F.col("m.comp") != F.col("p.comp")) & near & may("m", "p"))
            pairs = steps.cut(pairs.select(F.col("p.cls").alias("p_cls"), F.col("m.cls").alias("cls"), F.col("p.comp").alias("p_comp"), F.col("m.comp").alias("comp")).distinct(), "pairs")
            x = values(pairs.select(F.col("p_cls").alias("cls")).distinct()).toDF("p_cls", "x")
            y = values(pairs.select("cls").distinct()).toDF("cls", "y")
            d, link = measure("x", "y")
            tried = cut_lineage(pairs.join(x, "p_cls").join(y, "cls").select("p_cls", "cls", "p_comp", "comp", d.alias("d"), link.alias("link")), "tried")
            roots = contract(tried.filter("link").select(F.least("comp", "p_comp").alias("a"), F.greatest("comp", "p_comp").alias("b")))
            further = comp.join(roots.withColumnRenamed("v", "comp"), "comp", "left").select("cls", F.coalesce("root", "comp").alias("comp"))
            further = cut_lineage(further, "components")
            # this pass's pivots are done in their cells; the rest keep their distance from the first of them
            lead = p.filter("rank = 1").select("sig", F.col("cls").alias("p_cls"))
            rest = m.join(p.select("sig", "cls"), ["sig", "cls"], "left_anti").drop("comp", "dist").join(lead, "sig").join(tried.select("p_cls", "cls", F.col("d").alias("dist")), ["p_cls", "cls"], "left")
            left = cut_lineage(rest.select(*columns, "degree", "dist"), "left")
            remove(m, comp, roots, tried)
            old, comp = left, further
        step += 1


def _first_ranks(m: DataFrame, k: int) -> DataFrame:
    """The k members of each cell with the most neighbours, with their rank; the first k of each part of a cell are all that is compared."""
    if k == 1:
        best = F.min_by(F.struct(*m.columns), F.struct(F.negative("degree"), "cls"))
        return m.groupBy("sig").agg(best.alias("p")).select("p.*", F.lit(1).alias("rank"))
    order = (F.desc("degree"), F.col("cls"))
    part = F.pmod("cls", F.lit(SPLIT))
    m = m.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("sig", "part").orderBy(*order))).filter(F.col("rank") <= k)
    return m.withColumn("rank", F.row_number().over(Window.partitionBy("sig").orderBy(*order))).filter(F.col("rank") <= k).drop("part")
