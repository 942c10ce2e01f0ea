"""Detected sets of groups, their membership and exclusive intersections; annotation joins and proportions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def group_sets(q: DataFrame, min_reps: int = 1) -> DataFrame:
    """(grp, feature_id, replicates): features identified in at least min_reps samples of the group."""
    return q.groupBy("grp", "feature_id").agg(F.count("ident").alias("replicates")).filter(F.col("replicates") >= min_reps)


def membership(sets: DataFrame, groups: list[str]) -> DataFrame:
    """feature_id and a flag of 0 or 1 for each group."""
    flags = [F.max((F.col("grp") == g).cast("int")).alias(g.lower().replace(" ", "_")) for g in groups]
    return sets.groupBy("feature_id").agg(*flags)


def intersections(sets: DataFrame, groups: list[str]) -> DataFrame:
    """(combo, proteins): features by the exact combination of groups that have them."""
    flags = F.concat(*[F.max((F.col("grp") == g).cast("int")).cast("string") for g in groups])
    return sets.groupBy("feature_id").agg(flags.alias("combo")).groupBy("combo").agg(F.count(F.lit(1)).alias("proteins"))


def check_groups(sizes: dict[str, int], most: int | None = None) -> None:
    """Sets that a comparison can't use are refused."""
    full = sum(n > 0 for n in sizes.values())
    if not full:
        raise ValueError("no group has proteins")
    if full < 2:
        raise ValueError("At least two groups need proteins")
    if most is not None and full > most:
        raise ValueError(f"At most {most} groups can be drawn")


def compared(sets: DataFrame, groups: list[str], most: int | None = None) -> DataFrame:
    """intersections of sets that a comparison can use."""
    check_groups({r.grp: r.n for r in sets.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).collect()}, most)  # a row a group
    return intersections(sets, groups)


def annotated(sets: DataFrame, annotations: DataFrame) -> DataFrame:
    return sets.select("grp", F.col("feature_id").alias("accession")).join(annotations, "accession", "left")


def coverage(sets: DataFrame, annotations: DataFrame) -> DataFrame:
    own = sets.filter("feature_id <> ''").select("grp", F.col("feature_id").alias("accession")).distinct()
    a = own.join(annotations.select("accession", F.lit(1).alias("hit")).distinct(), "accession", "left")
    n, m = F.count(F.lit(1)), F.count("hit")
    return a.groupBy("grp").agg(n.alias("queried"), m.alias("matched"), (n - m).alias("unmatched"), F.round(100.0 * m / n, 6).alias("match_percent"))


def tm_category(column: str) -> F.Column:
    c = F.col(column)
    return F.when(c >= 3, ">=3").when(c.isNotNull(), c.cast("string"))


def tm_proportions(long: DataFrame) -> DataFrame:
    """Every category in every group, 0 where none. Proteins whose annotation_status says that no entry was found don't count."""
    if "annotation_status" in long.columns:
        long = long.filter(~F.coalesce(F.col("annotation_status") == "not_found_in_uniprot", F.lit(False)))
    n = long.filter("tm_helices is not null").groupBy("grp").agg(*[F.count_if(tm_category("tm_helices") == k).alias(k) for k in ("0", "1", "2", ">=3")])
    flat = n.unpivot("grp", ["0", "1", "2", ">=3"], "tm_category", "protein_count")
    total = F.sum("protein_count").over(Window.partitionBy("grp"))
    return flat.withColumn("denominator", total).withColumn("proportion", F.round(F.col("protein_count") / F.col("denominator"), 6))


def class_proportions(long: DataFrame) -> DataFrame:
    n = long.filter("subcellular_class <> ''").groupBy("grp", "subcellular_class").agg(F.count(F.lit(1)).alias("n"))
    n = n.withColumn("denominator", F.sum("n").over(Window.partitionBy("grp")))
    p = F.col("n") / F.col("denominator")
    return n.withColumn("proportion", F.round(p, 6)).withColumn("label", F.when(p >= 0.06, F.format_string("%.1f%%", F.round(p * 100, 1))).otherwise(""))
