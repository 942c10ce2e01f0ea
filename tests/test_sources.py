"""Importers on literal tables with exact expectations."""

import pytest
from pyspark.sql import functions as F

from quillon.plans.run import run
from quillon.sources import bridge, sinks, vendor
from quillon.sources.vendor import MatrixError, ZeroMode


def put(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text, encoding="utf-8")
    return str(p)


def cells(d, column="value"):
    return {(r.feature_id, r.sample): r[column] for r in d.cells.collect()}


STANDARD = "﻿feature id,control A,treat-1,Sci.Sample\nProteinA,123.4,0,1.2e3\nProteinB,85.1, ,NA\nProteinC,0,41.7,NaN\nProteinD,-2.5,3,4\n"


@pytest.mark.parametrize(("mode", "available"), [(ZeroMode.VALUE, 9), (ZeroMode.MISSING, 7)])
def test_standard_matrix(spark, tmp_path, mode, available):
    d = vendor.load_matrix(spark, put(tmp_path, "m.csv", STANDARD), mode)
    got = cells(d)
    assert len(got) == 12 and sum(v is not None for v in got.values()) == available
    assert cells(d, "raw_value")[("ProteinA", "treat-1")] == 0 and got[("ProteinA", "Sci.Sample")] == 1200


@pytest.mark.parametrize(
    ("name", "text", "says"),
    [
        ("a.csv", "feature\nx\n", "identifier"), ("a.csv", "feature,s1,s1\nx,1,2\n", "repeated"), ("a.csv", "feature,s1\n,1\n", "blank"), ("a.csv", "f,s1\nx,1\nx,2\n", "repeated"),
        ("a.csv", "f,s1\nx,abc\n", "s1 holds text: abc"), ("a.csv", "f,s1\nx,Inf\n", "infinite"), ("a.csv", "f,s1\nx,-Inf\n", "infinite"), ("a.csv", "f,s1,s2\nx,0,1\n", "no values"),
        ("a.csv", "f\ts1\nx\t1\n", "delimiter"), ("a.txt", "f,s1\nx,1\n", ".csv or .tsv"),
    ],
)
def test_standard_errors(spark, tmp_path, name, text, says):
    with pytest.raises(MatrixError, match=says):
        vendor.load_matrix(spark, put(tmp_path, name, text), ZeroMode.MISSING)
    with pytest.raises(MatrixError, match="zeros"):
        vendor.load_matrix(spark, "x.csv", None)


def test_fragpipe(spark, tmp_path):
    text = "Protein\tProtein ID\tEntry Name\tGene\tS1 MaxLFQ Intensity\tS2 MaxLFQ Intensity\tS1 Spectral Count\tS2 Spectral Count\tS1 Total Spectral Count\n"
    text += "sp|P001|A\tP001\tA_X\tGA\t0\t100\t3\t0\t9\nsp|P002|B\tP002\tB_X\tGB\t25\t0\t0\t5\t9\n"
    d = vendor.load(spark, put(tmp_path, "f.tsv", text), "dda")
    assert d.format == "fragpipe"
    assert cells(d) == {("P001", "S1"): None, ("P001", "S2"): 100, ("P002", "S1"): 25, ("P002", "S2"): None}
    assert cells(d, "ident") == {("P001", "S1"): 3, ("P001", "S2"): None, ("P002", "S1"): None, ("P002", "S2"): 5}


def test_peaks(spark, tmp_path):
    text = "Protein Group\tTop\tAccession\tArea S1\tArea S2\tCoverage(%)\tCoverage(%) S1\tCoverage(%) S2\n"
    text += "1\tTRUE\tP10001\t5\t0\t9\t1\t0\n1\tTRUE\tP10001_alt\t7\t7\t9\t1\t1\n2\tFALSE\tP20002\t0\t6\t9\t0\t2\n"
    d = vendor.load(spark, put(tmp_path, "p.tsv", text), "dda")
    assert d.format == "peaks_db" and sorted(r.feature_id for r in d.meta.collect()) == ["P10001", "P20002"]
    assert sum(v is not None for v in cells(d, "ident").values()) == 2
    lfq = "Protein Group\tTop\tAccession\tSample Profile (Ratio)\tS1 Area\tGroup 1 Area\n1\tTRUE\tP1\tx\t4\t4\n"
    d = vendor.load(spark, put(tmp_path, "l.tsv", lfq), "dda")
    assert d.format == "peaks_lfq" and cells(d) == {("P1", "S1"): 4} and cells(d, "ident") == {("P1", "S1"): None}


def test_maxquant(spark, tmp_path):
    text = "Protein IDs\tMajority protein IDs\tFasta headers\tGene names\tReverse\tPotential contaminant\tOnly identified by site\tLFQ intensity S1\tLFQ intensity S2\n"
    text += "P1;P9\tP1\tsp|P1|NAME_X text\tG\t\t\t\t10\t0\n" + "P2\tP2\tsp|P2|B\tG\t+\t\t\t1\t1\nP3\tP3\tsp|P3|C\tG\t\t+\t\t1\t1\nP4\tP4\tsp|P4|D\tG\t\t\tTRUE\t1\t1\n"
    d = vendor.load(spark, put(tmp_path, "m.tsv", text), "dda")
    assert d.format == "maxquant" and cells(d) == {("P1", "S1"): 10, ("P1", "S2"): None} and d.meta.first().protein_name == "NAME_X"


def test_dia_formats(spark, tmp_path):
    text = "Protein.Group\tProtein.Ids\tProtein.Names\tGenes\tC:\\run\\a.d\tb.d\nP1\tP1\tDup\tG\t0\t2\nP2\tP2\tDup\tG\t3\t\n"
    d = vendor.load(spark, put(tmp_path, "d.tsv", text), "dia", row_id="protein_name")
    assert d.format == "diann" and cells(d) == {("Dup", "a"): 0, ("Dup", "b"): 2, ("Dup.1", "a"): 3, ("Dup.1", "b"): None}
    text = "PG.ProteinGroups\tPG.ProteinAccessions\tPG.Genes\tPG.ProteinNames\t[1] s1.raw.PG.Quantity\t[2] s2.raw.PG.Quantity\t[1] s1.raw.PG.IBAQ\t[2] s2.raw.PG.IBAQ\nP1\tP1\tG\tN\t1\t2\t\t5\n"
    d = vendor.load(spark, put(tmp_path, "s.tsv", text), "dia")
    assert d.format == "spectronaut" and cells(d, "ident") == {("P1", "s1"): None, ("P1", "s2"): 5}
    with pytest.raises(MatrixError):
        vendor.load(spark, put(tmp_path, "n.tsv", "a\tb\n1\t2\n"), "dia")


def test_sinks_and_groups(spark, tmp_path):
    d = vendor.load_matrix(spark, put(tmp_path, "m.csv", STANDARD), ZeroMode.VALUE)
    q = vendor.with_groups(d.cells, {"treat-1": "T", "control A": " "})
    assert {r.sample: r.grp for r in q.collect()} == {"treat-1": "T", "control A": "Group1", "Sci.Sample": "Group1"}
    out = sinks.write_matrix(q, ["control A", "treat-1", "Sci.Sample"], str(tmp_path / "out"))
    assert spark.read.csv(out, header=True).count() == 4
    m = sinks.write_manifest(spark, str(tmp_path), "qc", {"n": 1}, [out])
    assert m["analysis"]["id"] == "qc" and spark.read.text(str(tmp_path / "analysis_summary.html")).count() > 0


def test_run_writes_rows_and_manifest(spark, tmp_path):
    from quillon.plans.run import run

    m = run(spark, "sample_counts", "/root/testdata/sf0.001", str(tmp_path))
    assert spark.read.parquet(m["outputs"][0]).count() > 0
    with pytest.raises(KeyError):
        run(spark, "none", "x", "y")


def lines(tmp_path, name, *rows):
    f = tmp_path / name
    f.write_text("\n".join("\t".join(r) for r in rows))
    return str(f)


def test_diann_without_vendor_suffixes(spark, tmp_path):
    path = lines(tmp_path, "a.tsv", ["Protein.Group", "Genes", "Note", "s1", "s2"], ["P1", "G1", "x", "1.5", ""], ["", "G2", "y", "3", "4"], ["P1", "G3", "z", "5", "6"], ["P1.1", "G4", "z", "7", "8"])
    d = vendor.load(spark, path, "dia")
    assert d.format == "diann" and "2 quantity" in d.evidence
    got = {(r.feature_id, r.sample): r.value for r in d.cells.collect()}
    assert got == {("P1", "s1"): 1.5, ("P1", "s2"): None, ("P1.2", "s1"): 5, ("P1.2", "s2"): 6, ("P1.1", "s1"): 7, ("P1.1", "s2"): 8}  # the blank accession is dropped, a taken number skipped
    upper = vendor.load(spark, lines(tmp_path, "b.tsv", ["Protein.Group", "run.RAW"], ["P1", "2"]), "dia")
    assert [r.sample for r in upper.cells.collect()] == ["run"]


def test_maxquant_needs_headers_and_falls_back(spark, tmp_path):
    with pytest.raises(vendor.MatrixError):
        vendor.load(spark, lines(tmp_path, "a.tsv", ["Protein IDs", "LFQ intensity a"], ["P1", "1"]), "dda", "maxquant")
    d = vendor.load(spark, lines(tmp_path, "b.tsv", ["Protein IDs", "Fasta headers", "Protein names", "LFQ intensity a"], ["P1", "sp|P1|ONE_X", "One", "1"], ["P2", "", "Two", "1"], ["P3", "", "", "1"]), "dda")
    assert {r.row_id: r.protein_name for r in d.meta.collect()} == {"P1": "ONE_X", "P2": "Two", "P3": "P3"}


def test_peaks_marks():
    names = ["Protein Group", "Top", "Accession", "a Area", "My Profile"]
    assert vendor.detect(names, "dda")[0] is None
    assert vendor.detect([*names, "Significance"], "dda")[0] == "peaks_lfq" and vendor.detect([*names, "Group 1 Area"], "dda")[0] == "peaks_lfq"


def test_unique_names():
    assert vendor.unique_names(["x", "x", "x.1", "x", "y"]) == ["x", "x.2", "x.1", "x.3", "y"]


def test_summaries_and_exports(spark, tmp_path):
    f = tmp_path / "m.csv"
    f.write_text("id,a,b\nP,0,1\nQ,NA,2\nR,3,4")
    d = vendor.load_dataset(spark, str(f), "standard", vendor.ZeroMode.MISSING)
    got = {r.Metric: r.Value for r in vendor.input_summary(d).collect()}
    assert len(got) == 12 and got["Original zero cell count"] == "1" and got["Explicit missing value count"] == "1" and got["Available quantitative value proportion"] == "66.67%" and got["File type"] == "CSV"
    paths = sinks.write_loaded(spark, str(tmp_path / "out"), d, ["a", "b"])
    assert len(paths) == 5 and sinks.outputs(spark, str(tmp_path / "out")).count() >= 5
    assert [r.Metric for r in vendor.format_summary(d, "standard").collect()][1] == "Detected/selected format"
    assert sinks.write_settings(spark, str(tmp_path), {"Analysis": "Random forest!", "Trees": 500}).endswith("/random_forest_ml_settings.csv")


def test_annotations(spark, tmp_path):
    f = tmp_path / "a.csv"
    f.write_text("Accession,GRAVY,TM_helices,Subcellular_class,MW,pI,Length,More\nP1,-0.5,2,Membrane,10.5,7.1,90,x\nP2,,none,,,,,")
    rows = vendor.read_annotations(spark, str(f)).collect()
    assert rows[0].TM_helices == 2 and rows[0].pI == 7.1 and rows[1].TM_helices is None and rows[0].More == "x"
    f.write_text("Accession,GRAVY\nP1,1")
    with pytest.raises(vendor.MatrixError, match="TM_helices, Subcellular_class"):
        vendor.read_annotations(spark, str(f))


def test_failed_run_leaves_a_manifest(spark, tmp_path):
    with pytest.raises(Exception):
        run(spark, "qc_sample_summary", "/nowhere", str(tmp_path))
    m = spark.read.text(str(tmp_path / "qc_sample_summary_manifest" / "analysis_manifest.json")).collect()
    assert "failed" in " ".join(r.value for r in m)


def test_diann_tables_identified_by_names_or_genes(spark, tmp_path):
    for column in ("Protein.Names", "Genes"):
        assert vendor.detect([column, "a.raw"], "dia")[0] == "diann"
        d = vendor.load(spark, lines(tmp_path, f"{column}.tsv", [column, "a.raw"], ["ONE", "1"], ["TWO", "2"]), "dia")
        assert {(r.feature_id, r.value) for r in d.cells.collect()} == {("ONE", 1.0), ("TWO", 2.0)}


def test_proteome_discoverer_and_area_names(spark, tmp_path):
    assert vendor.FORMATS["proteome_discoverer"].quantity(["Accession", "Abundance: F1: a", "Abundances: b", "Abundance Ratio: c", "Abundance"]) == [("Abundance: F1: a", "a"), ("Abundances: b", "b"), ("Abundance Ratio: c", "c"), ("Abundance", "Sample1")]
    assert vendor.FORMATS["peaks_lfq"].quantity(["Area Area", "b Area"])[1] == ("b Area", "b")
    assert vendor.FORMATS["peaks_db"].quantity(["Area Area", "Area : x"]) == [("Area Area", "Sample1"), ("Area : x", "x")]
    path = lines(tmp_path, "pd.tsv", ["Accession", "Description", "Abundance: F1: a", "Abundance: F2: b"], ["P1", "one", "0", "2.5"])
    d = vendor.load(spark, path, "dda", "proteome_discoverer")
    assert {(r.sample, r.value) for r in d.cells.collect()} == {("a", 0.0), ("b", 2.5)}  # zeros stay
    assert vendor.detect(["Accession", "Abundance: F1: a"], "dda")[0] is None


def test_contracts(spark, tmp_path):
    df = spark.createDataFrame([("A", 20.5)], "grp string, median_cv double")
    assert sinks.contracted(df, "cv_values_median").columns == ["Group", "MedianCV"]
    with pytest.raises(ValueError, match="lacks median_cv; has cv"):
        sinks.contracted(df.withColumnRenamed("median_cv", "cv"), "cv_values_median")
    wide = spark.createDataFrame([("P1", 1.0, 2.0)], "feature_id string, `s.1` double, s2 double")
    assert sinks.contracted(wide, "protein_sample_quantity_matrix", ["s.1", "s2"]).columns == ["ProteinID", "s.1", "s2"]
    for extra in ([], ["s.1"], ["s.1", "s2", "s3"]):
        with pytest.raises(ValueError):
            sinks.contracted(wide, "protein_sample_quantity_matrix", extra)
    rows = spark.createDataFrame([("a", 1.0, 2.0, "A")], "sample string, tsne1 double, tsne2 double, grp string")
    assert sinks.contracted(rows, "tSNE_coordinates", perplexity=7, max_iter=1000).first().Perplexity == 7
    path = sinks.write_contract(df, str(tmp_path), "cv_values_median")
    assert path.endswith("/cv_values_median.csv") and spark.read.csv(path, header=True).columns == ["Group", "MedianCV"]


def test_queries_fit_their_contracts(spark):
    from quillon.plans import registry

    sf = "/root/testdata/sf0.001"
    for query, file, extra, given in [
        ("qc_sample_summary", "quantitative_qc_sample_summary", [], {}), ("cv_values", "cv_values", [], {}), ("annotation_coverage", "annotation_mapping_coverage", [], {}), ("tm_category_proportions", "TM_helices_category_proportions", [], {}),
        ("subcellular_proportions", "Subcellular_class_counts", [], {}), ("rank_abundance_log2", "rank_abundance_data", [], {"transform": "log2"}), ("correlation_group_order", "correlation_long", [], {"method": "pearson"}),
        ("qc_protein_wide", "quantitative_qc_protein_summary", None, {}), ("annotation_long", "detected_proteins_annotations_long", ["length", "mw", "subcellular_class", "tm_helices"], {}),
    ]:
        df = registry.QUERIES[query](spark, sf)
        extra = [c for c in df.columns if "_Quantified_" in c or "_Total_" in c] if extra is None else extra
        assert sinks.contracted(df, file, extra, **given).columns


def test_manifest_says_groups_versions_and_preparation(spark, tmp_path):
    from quillon.plans.run import run

    m = run(spark, ["correlation_pearson", "lineage_paths"], "/root/testdata/sf0.001", str(tmp_path))
    assert {"spark", "pyspark", "python", "numpy", "pandas", "pyarrow"} <= set(m["package_versions"])
    assert sum(len(g["samples"]) for g in m["grouping"]) == 10 and m["preprocessing"]["least_share_of_values"] == {"correlation_pearson": 0.3}
    names = spark.read.csv(str(tmp_path / "sample_metadata.csv"), header=True)
    assert names.columns == ["original_name", "display_name", "group_suffix", "group"] and names.count() == 10


def test_first_matches_and_lineages(spark, tmp_path):
    meta = spark.createDataFrame([("a", "P2", 2), ("a", "P1", 1), ("b", "P3", 3)], "feature_id string, accession string, row_idx long")
    got = vendor.accessions_of(meta, spark.createDataFrame([("a",), ("b",), ("c",)], "feature_id string")).collect()
    assert {r.feature_id: r.accession for r in got} == {"a": "P1", "b": "P3", "c": None}
    path = sinks.write_lineages(spark, str(tmp_path), spark.createDataFrame([(2, "A -> C"), (1, "A -> B")], "lineage int, path string"))
    assert [r.value for r in spark.read.text(path).collect()] == ["Lineage1: A -> B", "Lineage2: A -> C"]


def test_names_shown_must_differ(spark):
    cells = spark.createDataFrame([("f", "s1", 1.0)], "feature_id string, sample string, value double")
    with pytest.raises(ValueError):
        vendor.displayed(cells, spark.createDataFrame([("s1", "x"), ("s2", "x")], "sample string, display_name string"))


def test_annotations_that_were_not_found_do_not_count(spark):
    from quillon.operators import sets as st

    long = spark.createDataFrame([("A", 0, "ok"), ("A", 2, "not_found_in_uniprot"), ("A", 3, None)], "grp string, tm_helices int, annotation_status string")
    assert {r.tm_category: r.protein_count for r in st.tm_proportions(long).collect()} == {"0": 1, "1": 0, "2": 0, ">=3": 1}


def test_safe_names():
    from quillon.functions.text import safe_name

    assert [safe_name(x) for x in ("MIDDLE EAST", "a_b.c", "1st", "_x", ".2", ".x", "é-1")] == ["MIDDLE.EAST", "a_b.c", "X1st", "X_x", "X.2", ".x", "é.1"]


def test_csv_files_have_their_names_and_columns(spark, tmp_path):
    from quillon.plans.run import run

    m = run(spark, ["sample_counts", "volcano_table", "set_membership", "cv_median"], "/root/testdata/sf0.01", str(tmp_path), "csv")
    assert [p.rsplit("/", 1)[1] for p in m["outputs"]] == ["identified_protein_counts.csv", "volcano_EUROPE_vs_ASIA.csv", "group_detected_membership.csv", "cv_values_median.csv", "sample_metadata.csv"]
    read = lambda i: spark.read.csv(m["outputs"][i], header=True)
    assert read(0).columns == ["Sample", "Identified_Protein_Count", "Quantified_Protein_Count"] and "BH.Adjusted.P.Value" in read(1).columns
    assert read(2).columns == ["ProteinID", "africa", "america", "asia", "europe", "middle_east"] and read(3).columns == ["Group", "MedianCV"]


def test_quantities_and_evidence_name_the_same_samples(spark, tmp_path):
    head = ["PG.ProteinAccessions", "a.PG.Quantity", "b.PG.Quantity", "a.PG.IBAQ"]
    with pytest.raises(vendor.MatrixError, match="different samples"):
        vendor.load(spark, lines(tmp_path, "s.tsv", head, ["P1", "1", "2", "3"]), "dia", "spectronaut")


def test_feature_ids_of_any_length_differ(spark):
    rows = spark.createDataFrame([(7,), (12345678,), (123456789,), (None,)], "k long").select(bridge.feature_id("k").alias("f")).collect()
    assert [r.f for r in rows] == ["P0000007", "P12345678", "P123456789", None]


def test_a_table_that_has_been_read(spark):
    raw = spark.createDataFrame([("sp|A1|X", "3", 0), ("sp|A1|X", "0", 1), ("NA", "5", 2), (None, None, 3)], "`Protein IDs` string, `LFQ intensity a` string, row_idx long").withColumn("Fasta headers", F.lit(""))
    d = vendor.imported(raw, "dda")
    assert d.format == "maxquant"
    assert sorted((r.feature_id, r.sample, r.value) for r in d.cells.collect()) == [("A1", "a", 3.0), ("A1.1", "a", None)]
    m = vendor.matrix_of(spark.createDataFrame([("f", "1", "na", 0), ("g", "0", "2", 1)], "id string, a string, b string, row_idx long"), vendor.ZeroMode.MISSING)
    assert sorted((r.feature_id, r.sample, r.value) for r in m.cells.collect()) == [("f", "a", 1.0), ("f", "b", None), ("g", "a", None), ("g", "b", 2.0)]
