"""Quality control, counts, rank abundance, variation and correlation of samples."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.text import safe_name
from quillon.operators import places
from quillon.operators.matrix import feature, log2_1p, vectors


def pct(a, b) -> F.Column:
    return F.round(F.try_divide(a * 100.0, b), 6)


def qc_samples(d: DataFrame) -> DataFrame:
    """A row a sample. Its median is found by ranges, as a sample has as many values as there are features."""
    d = d.withColumn("x_", log2_1p(F.col("value")))
    n, have = F.count(F.lit(1)), F.count("value")
    per = d.groupBy("sample", "grp").agg(
        n.alias("total_proteins"), have.alias("quantified_proteins"), (n - have).alias("missing_values"), pct(n - have, n).alias("missing_percent"), F.round(F.avg("x_"), 6).alias("mean_log2_abundance"),
    )
    middle = places.medians(d, ["sample"], "x_").select("sample", F.round("median", 6).alias("median_log2_abundance"))
    return per.join(F.broadcast(middle), "sample", "left")  # a row a sample


def qc_features(d: DataFrame) -> DataFrame:
    x = log2_1p(F.col("value"))
    n, have = F.count(F.lit(1)), F.count("value")
    return d.groupBy("feature_id").agg(
        n.alias("total_samples"), have.alias("quantified_samples"), (n - have).alias("missing_samples"), pct(n - have, n).alias("missing_percent"),
        F.round(F.median(x), 6).alias("median_log2_abundance"), F.round(F.avg(x), 6).alias("mean_log2_abundance"),
    )


def qc_feature_groups(d: DataFrame) -> DataFrame:
    n, have = F.count(F.lit(1)), F.count("value")
    return d.groupBy("feature_id", "grp").agg(have.alias("quantified_n"), n.alias("total_n"), pct(have, n).alias("quantified_percent"))


def _distinct(names: list[str]) -> list[str]:
    """Names, repeated ones with a running number."""
    return [n if n not in names[:i] else f"{n}.{names[:i].count(n)}" for i, n in enumerate(names)]


def qc_features_wide(d: DataFrame, groups: list[str]) -> DataFrame:
    """qc_features with, for each group, how many of its samples quantify the feature, of how many, and the percentage, in columns that begin with the group's safe name."""
    own = []
    for g, key in zip(groups, _distinct([safe_name(g) for g in groups]), strict=True):
        of = F.col("grp") == g
        n, have = F.count_if(of), F.count_if(of & F.col("value").isNotNull())
        own += [have.alias(f"{key}_Quantified_N"), n.alias(f"{key}_Total_N"), pct(have, n).alias(f"{key}_Quantified_Percent")]
    return qc_features(d).join(d.groupBy("feature_id").agg(*own), "feature_id")


def qc_histogram(d: DataFrame) -> DataFrame:
    """Features by number of missing samples, every number from 0 to all."""
    per = d.groupBy("feature_id").agg((F.count(F.lit(1)) - F.count("value")).alias("missing_samples"), F.count(F.lit(1)).alias("n"))
    counts = per.groupBy("missing_samples").agg(F.count(F.lit(1)).alias("proteins"), F.max("n").alias("n"))
    all_ = counts.agg(F.sum("proteins").alias("all_"), F.max("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("missing_samples", "proteins"))).alias("m"))
    levels = all_.filter("n is not null").select(F.explode(F.sequence(F.lit(0).cast("long"), "n")).alias("missing_samples"), "m", "all_")
    proteins = F.coalesce(F.try_element_at("m", "missing_samples"), F.lit(0))
    return levels.select("missing_samples", proteins.alias("proteins"), pct(proteins, F.col("all_")).alias("percent"))


def qc_heatmap_top(d: DataFrame, n: int = 200) -> DataFrame:
    """Features with missing and with quantified samples, most missing first."""
    f = qc_features(d).filter("missing_samples > 0 and quantified_samples > 0")
    return f.select("feature_id", "missing_percent").orderBy(F.desc("missing_percent"), "feature_id").limit(max(1, n))


def sample_counts(q: DataFrame) -> DataFrame:
    return q.groupBy("sample", "grp").agg(F.count("ident").alias("identified_protein_count"), F.count("value").alias("quantified_protein_count"))


def group_counts(counts: DataFrame, column: str) -> DataFrame:
    return counts.groupBy("grp").agg(F.round(F.avg(column), 6).alias("mean"), F.round(F.stddev_samp(column), 6).alias("sd"), F.count(column).alias("n"))


def rank_abundance(q: DataFrame, transform: str = "log10") -> DataFrame:
    """Place of each value in its sample, largest first (ties by feature_id), and its transform."""
    value = F.col("value")
    shown = (F.log10 if transform == "log10" else F.log2)(value + 1)
    ranked = places.numbered(q.filter("value is not null and not isnan(value)").select("feature_id", "sample", "grp", "value"), ["sample"], [-value, F.col("feature_id")], "rank")
    return ranked.withColumn("transformed", F.round(shown, 6))


def variation(q: DataFrame, most: float | None = None) -> DataFrame:
    """Percent coefficient of variation of a feature in a group: two values at least and a positive mean."""
    v = q.groupBy("feature_id", "grp").agg(F.count("value").alias("n"), F.avg("value").alias("m"), F.stddev_samp("value").alias("s")).filter("n >= 2 and m > 0")
    v = v.select("feature_id", "grp", F.round(100 * F.col("s") / F.col("m"), 6).alias("cv"))
    return v if most is None else v.filter(F.col("cv").between(0, most))


def median_variation(q: DataFrame, most: float = 60.0) -> DataFrame:
    return places.medians(variation(q, most), ["grp"], "cv").select("grp", F.round("median", 6).alias("median_cv"))


def correlation(p: DataFrame, samples: DataFrame, method: str = "pearson") -> DataFrame:
    """(sample1, sample2, correlation) over the prepared x: one distributed pass sums all pairs of columns."""
    names = sorted(r.sample for r in samples.select("sample").collect())
    rows = vectors(p).select(array_to_vector("v").alias("v"))
    m = Correlation.corr(rows, "v", method).first()[0].toArray()
    out = [(a, b, round(float(m[i, j]), 6)) for i, a in enumerate(names) for j, b in enumerate(names)]
    return p.sparkSession.createDataFrame(out, "sample1 string, sample2 string, correlation double")


def in_group_order(corr: DataFrame, samples: DataFrame) -> DataFrame:
    """correlation with the places of both samples when they are ordered by group."""
    place = F.row_number().over(Window.orderBy("group_ord", "sample_ord")).alias("place")  # of the samples only
    order = samples.select("sample", "grp", place)
    one, two = (order.select(F.col("sample").alias(f"sample{i}"), F.col("grp").alias(f"group{i}"), F.col("place").alias(f"ordered{i}")) for i in (1, 2))
    return corr.join(F.broadcast(one), "sample1").join(F.broadcast(two), "sample2")


def missing_cells(d: DataFrame) -> DataFrame:
    return d.select("feature_id", "sample", F.col("value").isNull().alias("is_missing"), F.count("value").over(feature()).alias("valid"))


def gaps(rows: DataFrame, label: str, by: str) -> DataFrame:
    """(gap): the places in the order by (1, 2, ...) after which the label changes. rows are samples or a drawing's features, few."""
    nxt = F.lead(label).over(Window.orderBy(by))
    return rows.withColumn("next_", nxt).withColumn("gap", F.row_number().over(Window.orderBy(by))).filter(F.col("next_") != F.col(label)).select("gap")
