"""Running named analyses to files, with a manifest of what ran or of what failed."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from quillon.operators.reduce import lineage_paths
from quillon.plans.registry import QUERIES
from quillon.sources import bridge
from quillon.sources.sinks import sample_metadata, write_contract, write_lineages, write_manifest, write_table

#: Least share of samples with a value that an analysis keeps features by.
SHARES = {"correlation_pearson": 0.3, "correlation_spearman": 0.3, "pca_scores": 0.5, "tsne_coordinates": 0.5, "umap_coordinates": 0.5, "heatmap_zscore_topvar": 0.5, "pseudotime": 0.5, "rf_stability": 0.5, "l1_stability": 0.5, "combined_score": 0.5}

#: The file that a query's rows are written to as CSV: (contract, name, columns left out, values added, columns of *).
FILES = {
    "sample_counts": ("identified_protein_counts", None, ["grp"], {}, None),
    "qc_sample_summary": ("quantitative_qc_sample_summary", None, [], {}, None),
    "qc_protein_wide": ("quantitative_qc_protein_summary", None, [], {}, "_(Quantified_N|Total_N|Quantified_Percent)$"),
    "set_membership": ("group_detected_membership", None, [], {}, "^(?!feature_id$)"),
    "correlation_group_order": ("correlation_long", "pearson_correlation_long", [], {"method": "pearson"}, None),
    "rank_abundance_log2": ("rank_abundance_data", None, [], {"transform": "log2"}, None),
    "rank_abundance_log10": ("rank_abundance_data", None, [], {"transform": "log10"}, None),
    "cv_values": ("cv_values", None, [], {}, None),
    "cv_median": ("cv_values_median", None, [], {}, None),
    "pca_scores": ("PCA_coordinates", None, [], {}, None),
    "umap_coordinates": ("UMAP_coordinates", None, [], {}, None),
    "volcano_table": ("volcano", "volcano_EUROPE_vs_ASIA", [], {}, None),
    "annotation_coverage": ("annotation_mapping_coverage", None, [], {}, None),
    "annotation_long": ("detected_proteins_annotations_long", None, [], {}, "^(?!(grp|accession)$)"),
    "tm_category_proportions": ("TM_helices_category_proportions", None, [], {}, None),
    "subcellular_proportions": ("Subcellular_class_counts", None, [], {}, None),
    "forest_importance": ("random_forest_importance", None, ["rank"], {}, None),
    "sparse_coefficients": ("l1_nonzero_coefficients", None, [], {}, None),
    "sparse_scores": ("l1_feature_scores", None, ["rank"], {}, None),
    "combined_score": ("combined_feature_summary", None, [], {}, None),
    "pseudotime": ("pseudotime_by_sample", None, [], {}, None),
    "pseudotime_spearman": ("pseudotime_associated_proteins_spearman", None, [], {}, None),
}


def _write(df: DataFrame, query: str, out: str, fmt: str) -> str:
    """As CSV by the query's contract where it has one, else as it is."""
    if fmt != "csv" or query not in FILES:
        return write_table(df, f"{out}/{query}", fmt)
    contract, file, without, given, star = FILES[query]
    df = df.drop(*without)
    return write_contract(df, out, contract, [c for c in df.columns if star and re.search(star, c)], file, **given)


def run(spark: SparkSession, name: str | list[str], sf_dir: str, out: str, fmt: str = "parquet", note: str = "", export: bool = True) -> dict:
    """Writes the rows of a query, or of several, under out, as CSV in the files and columns of FILES, and returns the manifest; without export, the manifest alone is written. An unknown name is refused. A query that fails leaves a manifest with its error, which is raised again."""
    names = [name] if isinstance(name, str) else name
    for n in names:
        if n not in QUERIES:
            raise KeyError(f"no analysis {n}")
    title, done = "+".join(names), []
    place, parameters = f"{out}/{title}_manifest", {"input": sf_dir, "format": fmt}
    samples = None
    how = {"transform": "log2(x + 1)", "imputation": "median of the feature", "least_share_of_values": {n: SHARES[n] for n in names if n in SHARES}}
    try:
        samples = bridge.samples(spark, sf_dir)
        for n in names:
            df = QUERIES[n](spark, sf_dir)
            if export:
                done.append(_write(df, n, out, fmt))
                if n == "pseudotime":
                    done.append(write_lineages(spark, out, lineage_paths(df)))
        if export:
            done.append(write_contract(sample_metadata(samples), out, "sample_metadata"))
    except Exception as e:
        write_manifest(spark, place, title, parameters | {"status": "failed"}, done, f"{note} {type(e).__name__}: {e}".strip(), samples, how)
        raise
    return write_manifest(spark, place, title, parameters | {"status": "finished"}, done, note, samples, how)
