"""Protein result tables of several vendors and user-prepared matrices, as one long DataFrame.

A format is found by its header. Every format gives (feature_id, sample, grp, value, ident), a row for each cell, ident being the evidence of identification, and a metadata table. Whether zeros mean missing differs by format.
"""

from __future__ import annotations

import csv
import itertools
import re
from collections.abc import Callable
from dataclasses import dataclass
from enum import Enum

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions import text
from quillon.operators import policy


class ZeroMode(Enum):
    """What zeros of a user-prepared matrix mean."""

    VALUE = "zero_is_value"
    MISSING = "zero_is_missing"


class MatrixError(ValueError):
    """A table that can't be read as a matrix, with the reason."""


@dataclass(frozen=True)
class Format:
    """ids: column candidates for accession, protein name and gene name; quantity and ident: [(column, sample)] of a header."""

    name: str
    ids: dict[str, tuple[str, ...]]
    quantity: Callable[[list[str]], list[tuple[str, str]]]
    ident: Callable[[list[str]], list[tuple[str, str]]] | None
    zero_is_missing: bool
    ident_available: bool = True


@dataclass
class Dataset:
    format: str
    cells: DataFrame
    meta: DataFrame
    note: str = ""
    evidence: str = ""
    first_column: str = ""
    mode: str = ""
    ending: str = ""
    samples: tuple[str, ...] = ()


def delimiter(header: str) -> str:
    return next((d for d in ("\t", ";") if d in header), ",")


def unique_names(names: list[str]) -> list[str]:
    """A repeated name takes the next number that no other name has."""
    taken, used, out = set(names), {}, []
    for i, n in enumerate(names):
        if n in names[:i]:
            k = used.get(n, 0) + 1
            while f"{n}.{k}" in taken:
                k += 1
            used[n] = k
            n = f"{n}.{k}"
            taken.add(n)
        out.append(n)
    return out


def read_header(spark: SparkSession, path: str) -> tuple[str, list[str]]:
    """(delimiter, trimmed column names) of the first line."""
    first = spark.read.text(path).limit(1).collect()
    if not first:
        raise MatrixError("the file is empty")
    line = first[0].value.lstrip("﻿")
    d = delimiter(line)
    return d, [c.strip() for c in next(csv.reader([line], delimiter=d))]


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings, and row_idx, which rises in source order."""
    d, names = read_header(spark, path)
    schema = ", ".join(f"{text.quoted(n or f'V{i}')} string" for i, n in enumerate(unique_names(names)))
    return spark.read.schema(schema).csv(path, sep=d, header=True, quote='"', escape='"', enforceSchema=True).withColumn("row_idx", F.monotonically_increasing_id())


def _suffix(pattern: str, flags: int = 0) -> Callable[[list[str]], list[tuple[str, str]]]:
    """Columns that match, their sample in the pattern's first group."""
    p = re.compile(pattern, flags)
    return lambda names: _named([(n, clean_sample(m[1])) for n in names if (m := p.search(n))])


def _named(columns: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Columns whose sample has no name left, or no other than Area, are numbered."""
    count = itertools.count(1)
    return [(n, s if s and s != "Area" else f"Sample{next(count)}") for n, s in columns]


def clean_sample(name: str) -> str:
    """A run's name without its counter, folder and vendor suffix."""
    name = re.sub(r"^\[[0-9]+\]\s*", "", name).replace("\\", "/").rsplit("/", 1)[-1]
    name = re.sub(r"\.(d|raw|wiff)$", "", re.sub(r"\.PG\.(Quantity|IBAQ)$", "", name, flags=re.I), flags=re.I)
    return re.sub(r"^F[0-9]+\s*:\s*", "", name).strip()


# Columns of DIA-NN that describe proteins.
DIANN_DESCRIPTIONS = ("Protein.Group", "Protein.Ids", "Protein.Names", "Genes", "First.Protein.Description", "N.Sequences", "N.Proteotypic.Sequences", "Genes.Quantity", "Genes.Normalised", "Protein.Q.Value", "PG.Q.Value", "Global.Q.Value", "Q.Value")


def diann_columns(raw: DataFrame, names: list[str]) -> list[tuple[str, str]]:
    """Quantity columns of a table without vendor suffixes: those behind the last description (or all others) that hold a number."""
    last = max((i for i, n in enumerate(names) if n in DIANN_DESCRIPTIONS), default=len(names) - 1)
    some = names[last + 1 :] or [n for n in names if n not in DIANN_DESCRIPTIONS]
    if not some or not any(n in DIANN_DESCRIPTIONS[:4] for n in names):
        return []
    cells = raw.select(F.posexplode(F.array(*[F.col(text.quoted(n)) for n in some])).alias("i", "v"))
    held = {r.i for r in cells.filter(text.number(F.col("v")).isNotNull()).select("i").distinct().collect()}  # a row a column
    return [(n, clean_sample(n)) for i, n in enumerate(some) if i in held]


def _spectral(names: list[str]) -> list[tuple[str, str]]:
    return [(n, clean_sample(m[1])) for n in names if (m := re.match(r"(.+) Spectral Count$", n)) and not re.search(r"^Combined|( Unique| Total)$", m[1])]


def _peaks_lfq(names: list[str]) -> list[tuple[str, str]]:
    return [(n, clean_sample(m[1])) for n in names if (m := re.match(r"(.+)\s+Area$", n, re.I)) and not re.match(r"Group\s+[0-9]+\s+Area$", n, re.I)]


# The columns that identify a protein, by format, in order of preference, and marks of a PEAKS LFQ table.
FORMATS = {
    f.name: f
    for f in (
        Format("diann", {"accession": ("Protein.Group", "Protein.Ids", "Protein.Names", "Genes"), "protein_name": ("Protein.Names",), "gene_name": ("Genes",)}, _suffix(r"^(.+\.(?:d|raw|wiff))$", re.I), None, False),
        Format("spectronaut", {"accession": ("PG.ProteinAccessions", "PG.ProteinGroups"), "protein_name": ("PG.ProteinNames",), "gene_name": ("PG.Genes",)}, _suffix(r"^(.+\.PG\.Quantity)$", re.I), _suffix(r"^(.+\.PG\.IBAQ)$", re.I), False),
        Format("fragpipe", {"accession": ("Protein ID", "Protein", "Entry Name"), "protein_name": ("Entry Name", "Protein", "Protein ID", "Description"), "gene_name": ("Gene", "Gene Name", "Mapped Genes")}, _suffix(r"^(.+?) MaxLFQ (?:Unique )?Intensity$", re.I), _spectral, True),
        Format("peaks_db", {"accession": ("Accession", "Protein ID", "Protein Group"), "protein_name": ("Accession", "Description", "Protein ID"), "gene_name": ("Gene", "Gene Name")}, _suffix(r"^Area\s+:?\s*(.+)$", re.I), _suffix(r"^Coverage\(%\)\s+(.+)$", re.I), True),
        Format("peaks_lfq", {"accession": ("Accession", "Protein ID", "Protein Group"), "protein_name": ("Accession", "Description", "Protein ID"), "gene_name": ("Gene", "Gene Name")}, _peaks_lfq, None, True, ident_available=False),
        Format("maxquant", {"accession": ("Protein IDs", "Majority protein IDs"), "protein_name": ("Fasta headers", "Fasta Headers"), "gene_name": ("Gene names", "Gene Names")}, _suffix(r"^LFQ intensity (.+)$", re.I), None, True),
        Format("proteome_discoverer", {"accession": ("Accession", "Master Protein Accessions"), "protein_name": ("Description", "Protein Description", "Accession"), "gene_name": ("Gene Symbol", "Gene", "Gene ID")}, _suffix(r"^Abundances?\s*:?\s*(?:Ratio\s*:?\s*)?(.*)$", re.I), None, False),
    )
}
PEAKS_LFQ_MARKS = ("Sample Profile (Ratio)", "Group Profile (Ratio)", "Significance")
LABELS = {"diann": "DIA-NN", "spectronaut": "Spectronaut", "fragpipe": "FragPipe", "peaks_db": "PEAKS DB protein result", "peaks_lfq": "PEAKS LFQ protein result", "maxquant": "MaxQuant", "proteome_discoverer": "Proteome Discoverer", "standard": "Standard matrix"}
#: Formats that detection tries, by family, in order; the last above is only read when asked for.
FAMILIES = {"dia": ("diann", "spectronaut"), "dda": ("fragpipe", "peaks_db", "peaks_lfq", "maxquant")}


def detect(names: list[str], family: str) -> tuple[str | None, list[str]]:
    """(format or None, all that fit). A format fits if its quantities, its evidence and an identifier are there."""
    fits = []
    for key in FAMILIES[family]:
        f = FORMATS[key]
        ok = bool(f.quantity(names)) and any(c in names for c in f.ids["accession"]) and (f.ident is None or bool(f.ident(names)))
        if key.startswith("peaks"):
            ok = ok and {"Protein Group", "Top", "Accession"} <= set(names)
        if key == "peaks_lfq":
            ok = ok and "peaks_db" not in fits and (any(m in names for m in PEAKS_LFQ_MARKS) or any(re.match(r"Group\s+[0-9]+\s+Area$", n, re.I) for n in names))
        if ok:
            fits.append(key)
    return (fits[0] if fits else None), fits


_YES = ("+", "TRUE", "True", "true", "1")


def unmarked(column: str, marks: tuple[str, ...] = _YES) -> Column:
    """Rows that a column of marks doesn't mark."""
    return ~F.coalesce(F.trim(F.col(column)), F.lit("")).isin(*marks)


def without_zeros(value: Column, mode: ZeroMode) -> Column:
    """value, null at 0 where zeros mean missing."""
    return F.when(value != 0, value) if mode is ZeroMode.MISSING else value


def representative(df: DataFrame, key: Column | str, marked: Column, order: str) -> DataFrame:
    """The first marked row of each key, else its first."""
    own = Window.partitionBy(key).orderBy(F.desc(F.coalesce(marked, F.lit(False))), order)
    return df.withColumn("n_", F.row_number().over(own)).filter("n_ = 1").drop("n_")


def _keep(f: Format, raw: DataFrame) -> DataFrame:
    """Rows that the vendor doesn't mark as contaminants, one for each group of proteins."""
    if f.name == "maxquant":
        for c in ("Reverse", "Potential contaminant", "Only identified by site"):
            if c in raw.columns:
                raw = raw.filter(unmarked(text.quoted(c)))
    if f.name.startswith("peaks"):
        group = F.trim(F.col("`Protein Group`"))
        key = F.when(F.coalesce(group, F.lit("")) != "", group).otherwise(F.concat(F.lit("__missing_group_"), F.col("row_idx").cast("string")))
        raw = representative(raw, key, F.upper(F.trim("Top")).isin("TRUE", "T", "YES", "Y", "1"), "row_idx")
    return raw


def _first(raw: DataFrame, candidates: tuple[str, ...], how: Callable[[Column], Column]) -> Column:
    name = next((c for c in candidates if c in raw.columns), None)
    return how(F.col(text.quoted(name))) if name else F.lit(None).cast("string")


def _numbers(written: Column, zero_is_missing: bool) -> Column:
    v = text.number(written)
    return without_zeros(v, ZeroMode.MISSING if zero_is_missing else ZeroMode.VALUE)


def load(spark: SparkSession, path: str, family: str | None = None, fmt: str | None = None, row_id: str = "accession") -> Dataset:
    """A vendor's table; fmt names its format, else the family's detectors decide."""
    return imported(read_table(spark, path), family, fmt, row_id)


def imported(raw: DataFrame, family: str | None = None, fmt: str | None = None, row_id: str = "accession") -> Dataset:
    """load of a table that has been read: columns of strings under the vendor's names, and row_idx, which rises in source order."""
    names = [c for c in raw.columns if c != "row_idx"]
    note = ""
    if fmt is None:
        fmt, fits = detect(names, family or "dia")
        if fmt is None and (family or "dia") == "dia" and diann_columns(raw, names):
            fmt, fits = "diann", ["diann"]
        if fmt is None:
            raise MatrixError("No format of this family fits the header")
        note = f"also fits: {', '.join(fits[1:])}" if len(fits) > 1 else ""
    f = FORMATS[fmt]
    quantity = f.quantity(names) or (diann_columns(raw, names) if fmt == "diann" else [])
    if not quantity:
        raise MatrixError(f"{fmt}: no quantity columns")
    evidence = dict((s, c) for c, s in f.ident(names)) if f.ident else None
    if fmt == "spectronaut" and {s for _, s in quantity} != set(evidence):
        raise MatrixError("Quantity and IBAQ name different samples")
    if evidence is not None:
        quantity = [(c, s) for c, s in quantity if s in evidence]
    shown = unique_names([s or f"Sample{i + 1}" for i, (_, s) in enumerate(quantity)])
    raw = _keep(f, raw)
    if not any(c in names for c in f.ids["accession"]):
        raise MatrixError(f"{LABELS[fmt]}: no column identifies proteins")
    if fmt == "maxquant" and not any(c in names for c in f.ids["protein_name"]):
        raise MatrixError("MaxQuant: no column of Fasta headers, which name the entries")
    protein = text.entry_name if fmt in ("maxquant", "peaks_db", "peaks_lfq") else text.take_first
    raw = raw.withColumns({"accession_": _first(raw, f.ids["accession"], text.clean_accession), "protein_name_": _first(raw, f.ids["protein_name"], protein), "gene_name_": _first(raw, f.ids["gene_name"], text.take_first)})
    if fmt == "maxquant":  # entries that the header doesn't name
        raw = raw.withColumn("protein_name_", F.coalesce("protein_name_", _first(raw, ("Protein names", "Protein Names"), text.take_first), "accession_"))
    raw = raw.withColumn("row_id_", F.col(f"{row_id}_")).filter("row_id_ <> ''")
    raw = text.unique_ids(raw, "row_id_", ["row_idx"], "feature_id")
    # cells are made rows as they are written, and parsed then, so the plan has one parser however many samples there are
    none = F.lit(None).cast("string")
    cells = [F.struct(F.lit(label).alias("sample"), F.col(text.quoted(c)).alias("v"), (F.col(text.quoted(evidence[s])) if evidence is not None else none).alias("i")) for (c, s), label in zip(quantity, shown, strict=True)]
    value = _numbers(F.col("c.v"), f.zero_is_missing)
    ident = F.lit(None).cast("double") if not f.ident_available else value if evidence is None else _numbers(F.col("c.i"), fmt != "spectronaut")
    long = raw.select("feature_id", F.explode(F.array(*cells)).alias("c")).select("feature_id", "c.sample", value.alias("value"), ident.alias("ident"))
    meta = raw.select("row_idx", F.col("row_id_").alias("row_id"), "feature_id", F.col("accession_").alias("accession"), F.col("protein_name_").alias("protein_name"), F.col("gene_name_").alias("gene_name"))
    found = f"{LABELS[fmt]}: {len(quantity)} quantity columns" + (f", {len(evidence)} of identification" if evidence is not None else "")
    return Dataset(fmt, long, meta, note, found, names[0], samples=tuple(shown))


def load_matrix(spark: SparkSession, path: str, zero_mode: ZeroMode) -> Dataset:
    """A user-prepared matrix: identifiers in the first column, a sample in each other. Faults are reported with examples."""
    if not isinstance(zero_mode, ZeroMode):
        raise MatrixError("what zeros mean must be given")
    ending = path.rsplit(".", 1)[-1].lower()
    if ending not in ("csv", "tsv"):
        raise MatrixError("a matrix is a .csv or .tsv file")
    d, names = read_header(spark, path)
    if d != {"csv": ",", "tsv": "\t"}[ending]:
        raise MatrixError(f"the delimiter doesn't fit .{ending}")
    if len(names) < 2:
        raise MatrixError("a matrix has an identifier and at least one sample")
    own = names[1:]
    if len(set(own)) < len(own) or "" in own:
        raise MatrixError("sample names are blank or repeated")
    return matrix_of(read_table(spark, path), zero_mode, ending)


def matrix_of(raw: DataFrame, zero_mode: ZeroMode, ending: str = "") -> Dataset:
    """load_matrix of a table that has been read: strings, identifiers in the first column, a sample in each other, and row_idx."""
    names = [c for c in raw.columns if c != "row_idx"]
    own = names[1:]
    key = F.trim(F.coalesce(F.col(text.quoted(names[0])), F.lit("")))
    cells = F.array(*[F.struct(F.lit(s).alias("sample"), F.trim(F.coalesce(F.col(text.quoted(s)), F.lit(""))).alias("t")) for s in own])
    long = raw.select("row_idx", key.alias("feature_id"), F.explode(cells).alias("c")).select("row_idx", "feature_id", "c.sample", "c.t")
    missing = F.lower("t").isin("", "na", "nan")
    infinite = F.lower("t").rlike(r"^[+-]?inf(inity)?$")
    value = F.when(F.col("t").rlike(text.NUMBER), F.col("t").try_cast("double"))
    long = long.withColumns({"is_explicit_missing": missing, "infinite_": infinite, "raw_value": value}).withColumn("invalid_", ~missing & ~infinite & F.col("raw_value").isNull())
    long = long.withColumn("value", without_zeros(F.col("raw_value"), zero_mode))
    ids = long.filter(F.col("sample") == own[0]).groupBy("feature_id").agg(F.count(F.lit(1)).alias("n"))
    faults = ids.filter("feature_id = '' or n > 1").limit(1).collect()
    if faults:
        raise MatrixError("a feature is blank" if not faults[0].feature_id else f"feature {faults[0].feature_id} is repeated")

    def examples(flag: str) -> Column:
        return F.slice(F.array_sort(F.collect_set(F.when(F.col(flag), F.col("t")))), 1, 5)

    per = long.groupBy("sample").agg(examples("invalid_").alias("text"), examples("infinite_").alias("inf"), F.count("value").alias("n")).collect()
    for r in per:  # a row a sample
        if r.text:
            raise MatrixError(f"column {r.sample} holds text: {', '.join(r.text)}")
        if r.inf:
            raise MatrixError(f"column {r.sample} holds infinite values: {', '.join(r.inf)}")
    for r in per:
        if not r.n:
            raise MatrixError(f"sample {r.sample} has no values")
    out = long.select("feature_id", "sample", "raw_value", "value", F.col("value").isNull().alias("is_missing"), "is_explicit_missing", F.lit(None).cast("double").alias("ident"))
    return Dataset("standard", out, long.select("row_idx", "feature_id").distinct(), "", "identifiers and a column for each sample", names[0], zero_mode.value, ending, tuple(own))


def load_dataset(spark: SparkSession, path: str, family: str, zero_mode: ZeroMode | None = None, fmt: str | None = None, row_id: str = "accession") -> Dataset:
    """A table of family dia or dda, or a user-prepared matrix of family standard."""
    if family == "standard":
        return load_matrix(spark, path, zero_mode)
    if family not in FAMILIES:
        raise MatrixError(f"no family {family}")
    return load(spark, path, family, fmt, row_id)


def counters(cells: DataFrame, *by: str) -> DataFrame:
    """(by, cells, features, samples, raw_zeros, explicit_missing, missing, available) of load_matrix's cells."""
    n = F.count(F.lit(1))
    return cells.groupBy(*by).agg(
        n.alias("cells"), F.count_distinct("feature_id").alias("features"), F.count_distinct("sample").alias("samples"), F.count_if(F.col("raw_value") == 0).alias("raw_zeros"),
        F.count_if("is_explicit_missing").alias("explicit_missing"), (n - F.count("value")).alias("missing"), F.count("value").alias("available"),
    )


def _metrics(one: DataFrame, rows: list[tuple[str, Column]]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(k).alias("Metric"), v.cast("string").alias("Value")) for i, (k, v) in enumerate(rows)])
    return one.select(F.explode(pairs).alias("m")).select("m.*").orderBy("place").select("Metric", "Value")


def input_summary(d: Dataset) -> DataFrame:
    """(Metric, Value) of a user-prepared matrix. Repeated features and samples without values have been refused on loading."""
    share = F.coalesce(F.format_string("%.2f%%", 100 * F.try_divide("available", "cells")), F.lit("NA"))
    what = {"zero_is_value": "zeros are measured", "zero_is_missing": "zeros are missing"}.get(d.mode, "")
    c = F.col
    return _metrics(counters(d.cells), [
        ("File type", F.lit(d.ending.upper())), ("First column name", F.lit(d.first_column)), ("Feature count", c("features")), ("Sample count", c("samples")), ("Zero handling mode", F.lit(f"{d.mode} - {what}")),
        ("Original zero cell count", c("raw_zeros")), ("Explicit missing value count", c("explicit_missing")), ("Total missing value count after selected mode", c("missing")),
        ("Number of available quantitative values", c("available")), ("Available quantitative value proportion", share), ("Duplicate features present", F.lit("No")), ("All-missing sample columns present", F.lit("No")),
    ])


def format_summary(d: Dataset, family: str) -> DataFrame:
    """(Metric, Value) of a vendor's table. Every row has a cell of each sample, so rows are counted, not cells."""
    features = F.count_distinct("feature_id")
    one = d.meta.agg(features.alias("features"), F.when(features > 0, len(d.samples)).otherwise(0).alias("samples"))
    return _metrics(one, [("Input category", F.lit(family)), ("Detected/selected format", F.lit(LABELS[d.format])), ("Data level", F.lit("protein")), ("Feature count", F.col("features")), ("Sample count", F.col("samples")), ("Format evidence", F.lit(d.evidence or "chosen by hand"))])


ANNOTATION_SCHEMA = {"Accession": "string", "GRAVY": "double", "TM_helices": "int", "Subcellular_class": "string", "MW": "double", "pI": "double", "Length": "int"}


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """An annotation table (.csv with a header): the required columns by name and type, any others as strings."""
    df = spark.read.csv(path, header=True, quote='"', escape='"')
    if gone := [c for c in ANNOTATION_SCHEMA if c not in df.columns]:
        raise MatrixError(f"the annotation table lacks {', '.join(gone)}")
    return df.select(*[F.trim(text.quoted(c)).try_cast(ANNOTATION_SCHEMA[c]).alias(c) if c in ANNOTATION_SCHEMA else F.col(text.quoted(c)) for c in df.columns])


def accessions_of(meta: DataFrame, ids: DataFrame) -> DataFrame:
    """ids (feature_id) with accession, of the first row of meta that has the id; null where none has."""
    first = meta.groupBy("feature_id").agg(F.min_by("accession", "row_idx").alias("accession"))
    return ids.join(first, "feature_id", "left")


def displayed(cells: DataFrame, names: DataFrame) -> DataFrame:
    """cells of the samples in names (sample, display_name), by their display names."""
    names = policy.display_names(names)
    return cells.join(F.broadcast(names), "sample").withColumn("sample", F.col("display_name")).drop("display_name")


def with_metadata(counts: DataFrame, metadata: DataFrame) -> DataFrame:
    """counts with the metadata of the same sample and group."""
    return counts.join(F.broadcast(metadata), ["sample", "grp"], "left")


def with_groups(cells: DataFrame, groups: dict[str, str]) -> DataFrame:
    """cells with grp by sample; samples that aren't named, or with a blank group, are in Group1."""
    named = {s: g for s, g in groups.items() if g and g.strip()}
    if not named:
        return cells.withColumn("grp", F.lit("Group1"))
    table = F.create_map(*[F.lit(x) for kv in named.items() for x in kv])
    return cells.withColumn("grp", F.coalesce(F.try_element_at(table, F.col("sample")), F.lit("Group1")))
