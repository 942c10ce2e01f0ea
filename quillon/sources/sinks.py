"""Tables, matrices and manifests as files."""

from __future__ import annotations

import html
import json
import platform
import time

import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import text
from quillon.operators.matrix import wide
from quillon.operators.policy import slug


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> str:
    """csv has a header and empty nulls; parquet and json are written as they are."""
    w = df.write.mode("overwrite")
    w.csv(path, header=True, nullValue="") if fmt == "csv" else w.format(fmt).save(path)
    return path


def write_matrix(q: DataFrame, samples: list[str], path: str, column: str = "value", fmt: str = "csv") -> str:
    """feature_id and a column for each sample."""
    return write_table(wide(q, samples, column), path, fmt)


def _write_text(spark: SparkSession, content: str, path: str) -> None:
    spark.createDataFrame([(content,)], "value string").coalesce(1).write.mode("overwrite").text(path)


# The files of an analysis and their columns, with the column that each is taken from. * stands for a column each of the samples, groups or classes, by their own names.
CONTRACTS: dict[str, dict[str, str]] = {
    "protein_sample_quantity_matrix": {"ProteinID": "feature_id", "*": "*"},
    "protein_sample_qualitative_matrix": {"ProteinID": "feature_id", "*": "*"},
    "protein_sample_ibaq_matrix": {"ProteinID": "feature_id", "*": "*"},
    "standard_matrix_analysis_quantity_matrix": {"FeatureID": "feature_id", "*": "*"},
    "standard_matrix_raw_quantity_matrix": {"FeatureID": "feature_id", "*": "*"},
    "standard_matrix_missingness_matrix": {"FeatureID": "feature_id", "*": "*"},
    "identified_protein_counts": {"Sample": "sample", "Identified_Protein_Count": "identified_protein_count", "Quantified_Protein_Count": "quantified_protein_count"},
    "standard_matrix_available_quantitative_value_counts": {"Sample": "sample", "Identified_Protein_Count": "identified_protein_count", "Quantified_Protein_Count": "quantified_protein_count", "Available_Quantitative_Value_Count": "quantified_protein_count"},
    "sample_metadata": {"original_name": "sample", "display_name": "display_name", "group_suffix": "group_suffix", "group": "grp"},
    "group_summary": {"Group": "grp", "Mean": "mean", "SD": "sd", "N": "n", "Count_Column": "count_column"},
    "group_detected_membership": {"ProteinID": "feature_id", "*": "*"},
    "quantitative_qc_sample_summary": {"Sample": "sample", "Group": "grp", "Total_Proteins": "total_proteins", "Quantified_Proteins": "quantified_proteins", "Missing_Values": "missing_values", "Missing_Percent": "missing_percent", "Median_Log2_Abundance": "median_log2_abundance", "Mean_Log2_Abundance": "mean_log2_abundance"},
    "quantitative_qc_protein_summary": {"ProteinID": "feature_id", "Total_Samples": "total_samples", "Quantified_Samples": "quantified_samples", "Missing_Samples": "missing_samples", "Missing_Percent": "missing_percent", "Median_Log2_Abundance": "median_log2_abundance", "Mean_Log2_Abundance": "mean_log2_abundance", "*": "*"},
    "correlation_long": {"Method": "method", "Sample1": "sample1", "Group1": "group1", "OrderedSample1": "ordered1", "Sample2": "sample2", "Group2": "group2", "OrderedSample2": "ordered2", "Correlation": "correlation"},
    "rank_abundance_data": {"ProteinID": "feature_id", "Sample": "sample", "Raw_Abundance": "value", "Rank": "rank", "Transformed_Abundance": "transformed", "Transform": "transform", "Group": "grp"},
    "cv_values": {"ProteinID": "feature_id", "Group": "grp", "CV": "cv"},
    "cv_values_median": {"Group": "grp", "MedianCV": "median_cv"},
    "PCA_coordinates": {"Sample": "sample", "PC1": "pc1", "PC2": "pc2", "Group": "grp"},
    "UMAP_coordinates": {"Sample": "sample", "UMAP1": "umap1", "UMAP2": "umap2", "Group": "grp"},
    "tSNE_coordinates": {"Sample": "sample", "tSNE1": "tsne1", "tSNE2": "tsne2", "Group": "grp", "Perplexity": "perplexity", "MaxIter": "max_iter"},
    "volcano": {c: c.replace(".", "_") for c in ("ProteinID", "MeanA_Log2", "MeanB_Log2", "MeanA_Raw", "MeanB_Raw", "log2FC", "P.Value", "BH.Adjusted.P.Value", "FCMethod", "TestMethod", "PValueMethod", "AdjustedPValueMethod", "SignificanceMetric", "SignificanceValue", "Regulation")},
    "expression_heatmap_values": {"ProteinID": "feature_id", "KmeansCluster": "kmeans_cluster", "HierarchicalCluster": "hierarchical_cluster", "*": "*"},
    "expression_heatmap_row_order": {"RowOrder": "row_order", "ProteinID": "feature_id", "KmeansCluster": "kmeans_cluster", "HierarchicalCluster": "hierarchical_cluster"},
    "expression_heatmap_col_order": {"ColOrder": "col_order", "Sample": "sample", "Group": "grp", "KmeansCluster": "kmeans_cluster", "HierarchicalCluster": "hierarchical_cluster"},
    "annotation_mapping_coverage": {"Group": "grp", "Queried_Proteins": "queried", "Matched_Proteins": "matched", "Unmatched_Proteins": "unmatched", "Match_Percent": "match_percent"},
    "detected_proteins_annotations_long": {"Group": "grp", "Accession": "accession", "*": "*"},
    "TM_helices_category_proportions": {"Group": "grp", "TM_category": "tm_category", "protein_count": "protein_count", "denominator": "denominator", "proportion": "proportion"},
    "Subcellular_class_counts": {"Group": "grp", "Subcellular_class": "subcellular_class", "n": "n", "denominator": "denominator", "proportion": "proportion", "label": "label"},
    "random_forest_importance": {"ProteinID": "feature_id", "RFImportance": "importance"},
    "random_forest_stability_selection": {"ProteinID": "feature_id", "SelectionFrequency": "top20_frequency", "RFTop20Frequency": "top20_frequency", "RFTop50Frequency": "top50_frequency", "MeanDecreaseGini": "mean_gini", "MeanDecreaseGiniScaled": "gini_scaled", "StabilityScore": "forest_score", "Repeats": "repeats"},
    "l1_stability_selection": {"ProteinID": "feature_id", "SelectionFrequency": "l1_frequency", "L1SelectionFrequency": "l1_frequency", "StabilityScore": "l1_frequency", "Repeats": "repeats"},
    "l1_nonzero_coefficients": {"ProteinID": "feature_id", "Class": "class", "Coefficient": "coefficient"},
    "l1_feature_scores": {"ProteinID": "feature_id", "L1Score": "total", "NonzeroClasses": "classes"},
    "combined_feature_summary": {"ProteinID": "feature_id", "CombinedRank": "rank", "StabilityScore": "score"},
    "cross_validation_predictions": {"Sample": "Sample", "Fold": "Fold", "Actual": "Actual", "Predicted": "Predicted", "*": "*"},
    "confusion_matrix": {"Actual": "Actual", "*": "*"},
    "class_metrics": {c: c for c in ("Class", "TP", "FP", "TN", "FN", "Sensitivity", "Specificity", "Precision", "F1")},
    "summary_metrics": {"Metric": "Metric", "Value": "Value"},
    "roc_curve": {c: c for c in ("Specificity", "Sensitivity", "Threshold", "PositiveClass")},
    "pseudotime_by_sample": {"Sample": "sample", "Group": "grp", "Lineage": "lineage", "Pseudotime": "pseudotime"},
    "pseudotime_associated_proteins_spearman": {"ProteinID": "feature_id", "SpearmanR": "rho", "Pvalue": "p", "FDR": "q"},
    "feature_UMAP_selected_proteins": {"ProteinID": "feature_id", "Source": "source"},
}


def contracted(df: DataFrame, name: str, extra: list[str] = (), **given) -> DataFrame:
    """df with the columns that the file of this name has, in their order. given: values of columns that df lacks; extra: the columns that * stands for. A frame that lacks a column, or has one that the file doesn't, is refused."""
    columns = CONTRACTS[name]
    df = df.withColumns({k: F.lit(v) for k, v in given.items()})
    want = {s for s in columns.values() if s != "*"} | set(extra)
    lacks, more = want - set(df.columns), set(df.columns) - want
    if lacks or more or ("*" in columns) != bool(extra):
        raise ValueError(f"{name}: " + "; ".join(filter(None, [f"lacks {', '.join(sorted(lacks))}" if lacks else "", f"has {', '.join(sorted(more))}" if more else "", "the columns of * don't fit" if ("*" in columns) != bool(extra) else ""])))
    out = []
    for shown, source in columns.items():
        out += [F.col(text.quoted(c)) for c in extra] if source == "*" else [F.col(text.quoted(source)).alias(shown)]
    return df.select(*out)


def write_contract(df: DataFrame, folder: str, name: str, extra: list[str] = (), file: str | None = None, **given) -> str:
    """contracted, as a CSV of that name under folder, or of the name file, which prefixes it."""
    return write_table(contracted(df, name, extra, **given), f"{folder}/{file or name}.csv", "csv")


def versions(spark: SparkSession) -> dict[str, str]:
    """Versions of what computes."""
    import numpy
    import pandas
    import pyarrow

    return {"spark": spark.version, "pyspark": pyspark.__version__, "python": platform.python_version(), **{m.__name__: m.__version__ for m in (numpy, pandas, pyarrow)}}


def grouping(samples: DataFrame) -> list[dict]:
    """Each group and its samples, for a manifest."""
    rows = samples.groupBy("grp").agg(F.array_sort(F.collect_list("sample")).alias("s")).orderBy("grp").collect()  # samples are few
    return [{"group": r.grp, "samples": list(r.s)} for r in rows]


def write_manifest(spark: SparkSession, path: str, analysis: str, parameters: dict, outputs: list[str], note: str = "", samples: DataFrame | None = None, preprocessing: dict | None = None) -> dict:
    """What ran, with what, on which groups, to which files: JSON, and the same as a page of HTML."""
    out = {"time": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()), "package_versions": versions(spark), "grouping": grouping(samples) if samples is not None else [], "preprocessing": preprocessing or {}, "analysis": {"id": analysis, "parameters": parameters, "note": note}, "outputs": outputs}
    text_ = json.dumps(out, indent=1, default=str)
    _write_text(spark, text_, f"{path}/analysis_manifest.json")
    _write_text(spark, f"<html><body><h1>{html.escape(analysis)}</h1><pre>{html.escape(text_)}</pre></body></html>", f"{path}/analysis_summary.html")
    return out


def write_settings(spark: SparkSession, folder: str, settings: dict) -> str:
    """(Setting, Value) of an analysis, under its name."""
    rows = spark.createDataFrame([(k, "" if v is None else str(v)) for k, v in settings.items()], "Setting string, Value string")
    return write_table(rows.coalesce(1), f"{folder}/{slug(settings.get('Analysis', 'ml'))}_ml_settings.csv", "csv")


def write_lineages(spark: SparkSession, folder: str, paths: DataFrame) -> str:
    """A line for each lineage, few."""
    _write_text(spark, "\n".join(f"Lineage{r.lineage}: {r.path}" for r in paths.orderBy("lineage").collect()), f"{folder}/lineages.txt")
    return f"{folder}/lineages.txt"


def sample_metadata(samples: DataFrame) -> DataFrame:
    """(sample, display_name, group_suffix, grp): names as they are shown, by default the group's first letters and a running number."""
    suffix = F.lower(F.regexp_replace(F.substring("grp", 1, 3), "[^A-Za-z0-9]", ""))
    return text.short_names(samples, suffix, ["sample_ord"]).select("sample", F.col("short_name").alias("display_name"), suffix.alias("group_suffix"), "grp")


def write_loaded(spark: SparkSession, folder: str, d, samples: list[str], metadata: DataFrame | None = None) -> list[str]:
    """What loading a table gives, under its files' names: its matrices, the features' and samples' tables and the counts of cells."""
    own = "raw_value" in d.cells.columns
    kinds = {"standard_matrix_analysis_quantity_matrix": "value", "standard_matrix_raw_quantity_matrix": "raw_value", "standard_matrix_missingness_matrix": "is_missing"} if own else {"protein_sample_quantity_matrix": "value", "protein_sample_qualitative_matrix": "ident"}
    if getattr(d, "format", None) == "spectronaut":
        kinds["protein_sample_ibaq_matrix"] = "ident"  # what identifies a protein there
    out = [write_contract(wide(d.cells, samples, column), folder, name, samples) for name, column in kinds.items()]
    counts = d.cells.groupBy("sample").agg(F.count("value").alias("quantified_protein_count"), F.count("ident").alias("identified_protein_count"))
    out.append(write_contract(counts, folder, "standard_matrix_available_quantitative_value_counts" if own else "identified_protein_counts"))
    out.append(write_table(d.meta, f"{folder}/{'feature' if own else 'protein'}_metadata.csv", "csv"))
    if metadata is not None:
        out.append(write_contract(metadata, folder, "sample_metadata"))
    return out


def outputs(spark: SparkSession, folder: str) -> DataFrame:
    """(path, kilobytes, modified) of the files under a folder; their contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", F.round(F.col("length") / 1024, 1).alias("kilobytes"), F.col("modificationTime").alias("modified"))
