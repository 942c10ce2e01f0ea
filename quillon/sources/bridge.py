"""The feature-by-sample matrix of the star schema: parts are features, supplier nations samples, regions groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def feature_id(column: str) -> F.Column:
    digits = F.col(column).cast("string")
    return F.concat(F.lit("P"), F.lpad(digits, F.greatest(F.length(digits), F.lit(7)), "0"))  # lpad cuts what is longer


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample, grp, sample_ord, group_ord) of the suppliers' nations: 25 rows at most, whatever the scale."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    used = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("n_nationkey")).distinct()
    all_ = nation.join(region, nation.n_regionkey == region.r_regionkey).join(used, "n_nationkey")
    return all_.select(F.col("n_name").alias("sample"), F.col("r_name").alias("grp"), F.col("n_nationkey").alias("sample_ord"), F.col("r_regionkey").alias("group_ord"))


def quant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(feature_id, sample, grp, value, ident): summed prices, and the number of lines that weren't returned as evidence of identification (null for none)."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    own = samples(spark, sf_dir)
    # sum in front of the joins that only name the sample
    sums = lines.join(supplier, lines.l_suppkey == supplier.s_suppkey).groupBy("l_partkey", "s_nationkey").agg(
        F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("value"),
        F.nullif(F.count_if(F.col("l_returnflag") != "R"), F.lit(0)).alias("ident"),
    )
    named = sums.join(F.broadcast(own), sums.s_nationkey == own.sample_ord)  # 25 rows
    return named.select(feature_id("l_partkey").alias("feature_id"), "sample", "grp", "value", "ident")


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(accession, length, mw, subcellular_class, tm_helices) from part; a tenth of the parts has none."""
    part = table(spark, sf_dir, "part").filter("p_partkey % 10 <> 0")
    return part.select(feature_id("p_partkey").alias("accession"), F.col("p_size").cast("int").alias("length"), F.col("p_retailprice").alias("mw"), F.col("p_type").alias("subcellular_class"), (F.col("p_size") % 5).cast("int").alias("tm_helices"))
