"""Counts of cells that arrive as files in a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CELLS = "feature_id string, sample string, grp string, value double, ident double, arrived timestamp"


def cells(spark: SparkSession, folder: str) -> DataFrame:
    """Long cells as Parquet files, in the order they are dropped."""
    return spark.readStream.schema(CELLS).parquet(folder)


def counts(stream: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Identified and quantified cells of each sample by time of arrival; later data than `late` is left out."""
    w = F.window("arrived", window)
    out = stream.withWatermark("arrived", late).groupBy(w.alias("w"), "sample").agg(F.count("ident").alias("identified"), F.count("value").alias("quantified"))
    return out.select(F.col("w.start").alias("start"), "sample", "identified", "quantified")
