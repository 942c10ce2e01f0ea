"""Queries of the importers and of parsing: tables as vendors write them, of the star schema's matrix, read by the library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import text
from quillon.operators import differential as diff
from quillon.operators import matrix as mx
from quillon.operators import reduce as rd
from quillon.operators import select as sl
from quillon.plans.registry import _FITS, _TWO, A, B, DENSE_SQL, QUANT_SQL, half_prepared, prepared_sql, quant, query, rule_fits, rule_scores
from quillon.sources import bridge, vendor

#: The samples of a matrix of all nations.
NATIONS = [f"NATION_{i}" for i in range(25)]


def _written(c: Column) -> Column:
    """A cell as it is written: every fifth part was measured as 0, every seventh as no number."""
    return F.when(c.isNull(), None).when(F.col("k") % 5 == 0, "0").when(F.col("k") % 7 == 0, "NaN").otherwise(c.cast("string"))


def sheet(s, d, ids: dict[str, str], quantity: str, evidence: str | None = None) -> DataFrame:
    """A row a part: ids are made of k, the part's number; quantity and evidence name the columns of a sample, {n}, the {i}th. Cells are gathered as numbers and written in the part's row; k is aggregated as well, so what is asked of ids is asked of parts, not of lines."""
    q = quant(s, d)
    own = [r.sample for r in mx.sample_rows(bridge.samples(s, d))]
    names = [(name.format(n=n, i=i), column, n) for name, column in ((quantity, "value"), (evidence, "ident")) if name for i, n in enumerate(own, 1)]
    rows = q.groupBy("feature_id").agg(F.max(F.substring("feature_id", 2, 99).cast("long")).alias("k"), *[F.max(F.when(F.col("sample") == n, F.col(c))).alias(label) for label, c, n in names])
    cells = [_written(F.col(text.quoted(label))).alias(label) for label, *_ in names]
    return rows.select(*[F.expr(c).alias(n) for n, c in ids.items()], *cells, F.col("k").alias("row_idx"))


#: Two parts share an accession; every thirteenth has none.
ACCESSION = "case when k % 13 = 0 then 'NA' else format_string('sp|Q%07d|N%d_SYN;tr|R1|OTHER', k div 2, k) end"
#: A group of three parts, of which the second is marked, if it was measured.
GROUP = {"Protein Group": "cast(k div 3 as string)", "Top": "case when k % 3 = 1 then 'true' else 'false' end", "Accession": ACCESSION}
GENE = "format_string('G%d', k)"

#: Of each format: the columns of identifiers, and the names of a sample's columns of quantities and evidence.
SHEETS = {
    "diann": ({"Protein.Group": ACCESSION, "Protein.Names": "format_string('N%d_SYN;X', k)", "Genes": "format_string(' G%d ; H', k)"}, "[{i}] D:\\runs\\{n}.raw", None),
    "spectronaut": ({"PG.ProteinAccessions": ACCESSION, "PG.Genes": GENE}, "[{i}] {n}.raw.PG.Quantity", "[{i}] {n}.raw.PG.IBAQ"),
    "fragpipe": ({"Protein": ACCESSION, "Entry Name": "format_string('N%d_SYN', k)", "Gene": GENE}, "{n} MaxLFQ Intensity", "{n} Spectral Count"),
    "peaks_db": (GROUP, "Area {n}", "Coverage(%) {n}"),
    "peaks_lfq": (GROUP | {"Significance": "'20'"}, "{n} Area", None),
    "maxquant": (
        {
            "Protein IDs": ACCESSION, "Fasta headers": "case when k % 4 = 0 then 'unnamed' else format_string('sp|Q%07d|N%d_SYN a protein', k div 2, k) end", "Gene names": "format_string('G%d;H', k)",
            "Reverse": "case when k % 11 = 0 then '+' else '' end", "Potential contaminant": "case when k % 17 = 0 then 'true' else '' end",
        },
        "LFQ intensity {n}", None,
    ),
    "proteome_discoverer": ({"Accession": ACCESSION, "Description": "format_string('protein %d', k)", "Gene Symbol": GENE}, "Abundance: F{i}: {n}", None),
}


def imported(s, d, fmt: str) -> vendor.Dataset:
    family = next((f for f, formats in vendor.FAMILIES.items() if fmt in formats), None)
    return vendor.imported(sheet(s, d, *SHEETS[fmt]), family, None if family else fmt)


def _imported_sql(fmt: str) -> str:
    """r: the rows that stay, c: their cells."""
    stays = {"maxquant": "k % 11 <> 0 and k % 17 <> 0"}.get(fmt, "true")
    if fmt.startswith("peaks"):
        stays = "first_ = 1"
    zero = fmt in ("fragpipe", "peaks_db", "peaks_lfq", "maxquant")
    value = "cast(w as double)" if not zero else "nullif(w, 0)"
    ident = {"spectronaut": "i", "fragpipe": "nullif(i, 0)", "peaks_db": "nullif(i, 0)", "peaks_lfq": "cast(null as double)"}.get(fmt, value)
    return DENSE_SQL + f""", k1 as (select distinct feature_id as part, cast(substr(feature_id, 2) as bigint) as k from d),
k2 as (select *, row_number() over (partition by k // 3 order by case when k % 3 = 1 then 0 else 1 end, k) as first_ from k1),
k3 as (select part, k, printf('Q%07d', k // 2) as accession from k2 where {stays} and k % 13 <> 0),
r as (select *, accession || case when row_number() over (partition by accession order by k) > 1 then '.' || (row_number() over (partition by accession order by k) - 1) else '' end as feature_id from k3),
v as (select r.feature_id, d.sample, case when value is null then null when k % 5 = 0 then 0 when k % 7 = 0 then null else value end as w,
  case when ident is null then null when k % 5 = 0 then 0 when k % 7 = 0 then null else cast(ident as double) end as i from d join r on r.part = d.feature_id),
c as (select feature_id, sample, {value} as value, {ident} as ident from v)"""


def _importer(fmt: str):
    def cells(s, d):
        return imported(s, d, fmt).cells.select("feature_id", "sample", "value", "ident")

    cells.__name__ = f"import_{fmt}"
    cells.__doc__ = f"Cells of a table as {vendor.LABELS[fmt]} writes it."
    return query(_imported_sql(fmt) + " select feature_id, sample, value, ident from c")(cells)


for _fmt in SHEETS:
    _importer(_fmt)

_META = {
    "diann": ("'N' || k || '_SYN'", "'G' || k"), "fragpipe": ("'N' || k || '_SYN'", "'G' || k"), "peaks_db": ("'N' || k || '_SYN'", "cast(null as varchar)"),
    "maxquant": ("case when k % 4 = 0 then accession else 'N' || k || '_SYN' end", "'G' || k"),
}


def _proteins(fmt: str, protein: str, gene: str):
    def rows(s, d):
        return imported(s, d, fmt).meta.select("feature_id", "row_id", "accession", "protein_name", "gene_name")

    rows.__name__ = f"proteins_{fmt}"
    rows.__doc__ = f"Names of the proteins of a table as {vendor.LABELS[fmt]} writes it."
    return query(_imported_sql(fmt) + f" select feature_id, accession as row_id, accession, {protein} as protein_name, {gene} as gene_name from r")(rows)


for _fmt, _sql in _META.items():
    _proteins(_fmt, *_sql)

_EVIDENCE = {"diann": False, "spectronaut": True, "fragpipe": True, "peaks_db": True, "peaks_lfq": False, "maxquant": False}


def _summary_sql() -> str:
    out = []
    for fmt, two in _EVIDENCE.items():
        family = next(f for f, formats in vendor.FAMILIES.items() if fmt in formats)
        label = vendor.LABELS[fmt]
        found = f"'{label}: ' || samples || ' quantity columns'" + (" || ', ' || samples || ' of identification'" if two else "")
        rows = [("Input category", f"'{family}'"), ("Detected/selected format", f"'{label}'"), ("Data level", "'protein'"), ("Feature count", "cast(features as varchar)"), ("Sample count", "cast(samples as varchar)"), ("Format evidence", found)]
        one = f"({_imported_sql(fmt)} select count(distinct feature_id) as features, count(distinct sample) as samples from c)"
        out += [f"select '{fmt}' as sheet, '{k}' as \"Metric\", {v} as \"Value\" from {one}" for k, v in rows]
    return " union all ".join(out)


@query(_summary_sql())
def import_summaries(s, d):
    """What is found of each table: its format by its header, and its size."""
    every = None
    for fmt in _EVIDENCE:
        family = next(f for f, formats in vendor.FAMILIES.items() if fmt in formats)
        own = vendor.format_summary(imported(s, d, fmt), family).select(F.lit(fmt).alias("sheet"), "Metric", "Value")
        every = own if every is None else every.unionByName(own)
    return every


def matrix_sheet(s, d, mode: vendor.ZeroMode) -> vendor.Dataset:
    return vendor.matrix_of(sheet(s, d, {"Feature": "format_string('F%d', k)"}, "{n}"), mode, "tsv")


_MATRIX = DENSE_SQL + """, v as (select 'F' || k as feature_id, sample, case when value is null then null when k % 5 = 0 then 0 when k % 7 = 0 then null else value end as raw_value from (select *, cast(substr(feature_id, 2) as bigint) as k from d)),
m as (select feature_id, sample, raw_value, {value} as value, raw_value is null as is_explicit_missing from v)"""
_ZERO = {vendor.ZeroMode.VALUE: _MATRIX.replace("{value}", "raw_value"), vendor.ZeroMode.MISSING: _MATRIX.replace("{value}", "nullif(raw_value, 0)")}
_CELLS = " select feature_id, sample, raw_value, value, value is null as is_missing, is_explicit_missing from m"


@query(_ZERO[vendor.ZeroMode.VALUE] + _CELLS)
def standard_matrix(s, d):
    """Cells of a user-prepared matrix whose zeros were measured."""
    return matrix_sheet(s, d, vendor.ZeroMode.VALUE).cells.drop("ident")


@query(_ZERO[vendor.ZeroMode.MISSING] + _CELLS)
def standard_matrix_zero_is_missing(s, d):
    return matrix_sheet(s, d, vendor.ZeroMode.MISSING).cells.drop("ident")


@query(_ZERO[vendor.ZeroMode.MISSING] + """, n as (select count(*) as cells, count(distinct feature_id) as features, count(distinct sample) as samples, count(*) filter (where raw_value = 0) as zeros, count(*) filter (where is_explicit_missing) as gone, count(value) as have from m),
t as (select unnest([{'m': 'File type', 'v': 'TSV'}, {'m': 'First column name', 'v': 'Feature'}, {'m': 'Feature count', 'v': cast(features as varchar)}, {'m': 'Sample count', 'v': cast(samples as varchar)},
  {'m': 'Zero handling mode', 'v': 'zero_is_missing - zeros are missing'}, {'m': 'Original zero cell count', 'v': cast(zeros as varchar)}, {'m': 'Explicit missing value count', 'v': cast(gone as varchar)},
  {'m': 'Total missing value count after selected mode', 'v': cast(cells - have as varchar)}, {'m': 'Number of available quantitative values', 'v': cast(have as varchar)}, {'m': 'Available quantitative value proportion', 'v': printf('%.2f%%', 100.0 * have / cells)},
  {'m': 'Duplicate features present', 'v': 'No'}, {'m': 'All-missing sample columns present', 'v': 'No'}]) as x from n)
select x.m as "Metric", x.v as "Value" from t""")
def standard_matrix_summary(s, d):
    return vendor.input_summary(matrix_sheet(s, d, vendor.ZeroMode.MISSING))


@query(QUANT_SQL + " select feature_id, " + ", ".join(f"max(value) filter (where sample = '{n}') as \"{n}\"" for n in NATIONS) + " from q group by feature_id")
def wide_matrix(s, d):
    """A row a feature, a column for each nation."""
    return mx.wide(quant(s, d), NATIONS)


@query("""select c_custkey, case c_custkey % 7 when 0 then c_acctbal when 1 then -c_custkey when 2 then c_custkey * 1000.0 when 3 then 0.5 end as value from (select c_custkey, cast(c_acctbal as double) as c_acctbal from customer)""")
def numeric_tokens(s, d):
    """Numbers as they are written, and what is none."""
    key, money = F.col("c_custkey").cast("string"), F.col("c_acctbal").cast("double").cast("string")
    own = F.array(money, F.concat(F.lit(" -"), key, F.lit(";7 ")), F.concat(key, F.lit("E+3")), F.lit("+.5"), F.lit("NaN"), F.concat(key, F.lit(" apples")), F.lit("NULL"))
    return bridge.table(s, d, "customer").select("c_custkey", text.number(F.get(own, (F.col("c_custkey") % 7).cast("int"))).alias("value"))


_CHARGE = " + ".join([f"1 / (1 + 10 ** (mid - {text.PK_START}))", *[f"n_{k} / (1 + 10 ** (mid - {v}))" for k, v in text.PK_BASE.items()]]) + "".join(f" - {x}" for x in [f"1 / (1 + 10 ** ({text.PK_END} - mid))", *[f"n_{k} / (1 + 10 ** ({v} - mid))" for k, v in text.PK_ACID.items()]])
_COUNTS = ", ".join(f"cast(length(sequence) - length(replace(sequence, '{k}', '')) as double) as n_{k}" for k in (*text.PK_ACID, *text.PK_BASE))


@query(f"""with recursive q as (select printf('P%07d', p_partkey) as feature_id, p_partkey as k, translate(md5(cast(p_partkey as varchar)), '0123456789abcdef', 'ACDEFGHIKLMNPQRY') as sequence from part),
it as (select feature_id, {_COUNTS}, 0.0::double as low, 14.0::double as high, 7.0::double as mid, 0 as i from q
  union all select feature_id, {", ".join(f"n_{k}" for k in (*text.PK_ACID, *text.PK_BASE))}, lo, hi, (lo + hi) / 2, i + 1 from (select *, case when charge > 0 then mid else low end as lo, case when charge > 0 then high else mid end as hi from (select *, {_CHARGE} as charge from it where i < 40))),
t as (select feature_id, sequence, case k % 4 when 1 then 1 + k % 3 when 2 then 2 when 3 then 1 else 0 end as tm, k % 6 as place from q)
select t.feature_id, sequence, round(mid, 6) as pi, cast(tm as integer) as tm_helices, case place when 0 then 'Mitochondria' when 1 then 'Nucleus' when 2 then 'Cytoplasm' when 3 then 'Membrane' else case when tm > 0 then 'Membrane' else 'Other/Unknown' end end as subcellular_class from t join it on it.feature_id = t.feature_id and i = 40""")
def sequence_annotations(s, d):
    """Clean sequences, isoelectric points, transmembrane helices and places of texts that the part's number gives."""
    k = F.col("p_partkey")
    letters = F.translate(F.md5(k.cast("string").cast("binary")), "0123456789abcdef", "ACDEFGHIKLMNPQRY")
    raw = F.concat(F.lower(F.substring(letters, 1, 9)), F.lit(" *1"), F.substring(letters, 10, 99), F.lit("-X"))
    helix = F.when(k % 4 == 1, F.repeat(F.lit("TRANSMEM 7..27; "), (1 + k % 3).cast("int"))).when(k % 4 == 2, "helical 3..21 and 30..48").when(k % 4 == 3, "helical").otherwise(" ")
    places = F.array(*[F.lit(x) for x in ("Mitochondrion matrix", "NUCLEOLUS", "Cytosol", "Cell membrane", "Secreted")], F.lit(None).cast("string"))
    p = bridge.table(s, d, "part").select(bridge.feature_id("p_partkey").alias("feature_id"), raw.alias("raw"), text.tm_count(helix).cast("int").alias("tm_helices"), F.get(places, (k % 6).cast("int")).alias("place"))
    return p.select("feature_id", text.clean_sequence(F.col("raw")).alias("sequence"), F.round(text.isoelectric_point(F.col("raw")), 6).alias("pi"), "tm_helices", text.subcellular_class(F.col("place"), F.col("tm_helices")).alias("subcellular_class"))


_RANKED = _FITS + """, y as (select *, 0.35 * t20 + 0.25 * t50 + 0.10 * g as forest, 0.35 * t20 + 0.25 * t50 + 0.30 * l1 + 0.10 * g as both_ from z where t20 > 0 or t50 > 0 or l1 > 0 or mg > 0),
o as (select feature_id, round({score}, 6) as score, row_number() over (order by round({score}, 9) desc, t20 desc, t50 desc, round(mg, 9) desc, feature_id) as rank from y)
select cast(rank as integer) as rank, feature_id, score from o where rank <= 50"""


def _ranking(name: str, column: str, score: str):
    def best(s, d):
        return sl.ranked(rule_scores(s, d), column)

    best.__name__ = name
    best.__doc__ = f"The 50 best features by {column}, of ranks that a hash gives."
    return query(_RANKED.replace("{score}", score))(best)


for _name, _column, _score in (("forest_ranking", "forest_score", "forest"), ("frequency_ranking", "l1_frequency", "l1"), ("combined_ranking", "combined_score", "both_")):
    _ranking(_name, _column, _score)


@query(_FITS[: _FITS.index(", r as (")] + " select row_number() over (order by g desc, feature_id) as rank, feature_id, g as importance from (select feature_id, round(1.0 / gini_rank, 9) as g from f where repeat = 1 and gini_rank <= 200)")
def importance_order(s, d):
    """All of a repeat's features, the most important first."""
    f = rule_fits(s, d).filter("repeat = 1").select("feature_id", F.col("gini").alias("importance"))
    return sl.by_importance(f, "importance").select("rank", "feature_id", "importance")


@query(prepared_sql(0.5) + """, v as (select *, stddev_samp(x) over f as s, x - avg(x) over f as y from p window f as (partition by feature_id)), z as (select feature_id, sample, y / s as z from v where s > 0)
select a.sample as sample1, b.sample as sample2, round(sum(a.z * b.z), 4) + 0.0 as product from z a join z b using (feature_id) group by all""")
def sample_products(s, d):
    """Inner products of the samples' standardised profiles, of which coordinates are made."""
    return rd.inner_products(*half_prepared(s, d)).withColumn("product", F.round("product", 4) + F.lit(0.0))


@query(_TWO + """, m as (select *, n_a + n_b - 2 as dd, ((n_a - 1) * coalesce(var_a, 0) + (n_b - 1) * coalesce(var_b, 0)) / (n_a + n_b - 2) as s2 from s where n_a >= 1 and n_b >= 1 and n_a + n_b > 2),
t as (select feature_id, (mean_b - mean_a) / sqrt((4.0 * 0.05 + dd * s2) / (4.0 + dd) * (1.0 / n_a + 1.0 / n_b)) as t, cast(dd + 4 as bigint) as df from m),
a as (select feature_id, df, atan(abs(t) / sqrt(df)) as theta from t),
u as (select feature_id, df, theta, 1 + coalesce(list_sum([cos(theta) ** (2 * j) * list_aggregate([case when df % 2 = 0 then (2.0 * h - 1) / (2 * h) else 2.0 * h / (2 * h + 1) end for h in range(1, j + 1)], 'product') for j in range(1, (df - df % 2) // 2)]), 0) as series from a),
p as (select feature_id, round(case when df % 2 = 0 then 1 - sin(theta) * series else 1 - 2 / pi() * (theta + sin(theta) * cos(theta) * series) end, 9) as p from u),
r as (select *, row_number() over (order by p, feature_id) as i, count(*) over () as n from p) select feature_id, round(p, 7) as p, round(least(1.0, min(p * n / i) over (order by p desc, feature_id desc rows unbounded preceding)), 7) as q from r""")
def moderated_p(s, d):
    """p of the statistic with a given prior of 4 degrees of freedom and a variance of 0.05, by the t distribution, and adjusted."""
    m = diff.moderated_statistic(diff.two_groups(quant(s, d), A, B), 4.0, 0.05)
    p = m.select("feature_id", F.round(diff.p_value("t", "df"), 9).alias("p"))
    return diff.adjusted(p).select("feature_id", F.round("p", 7).alias("p"), F.round("q", 7).alias("q"))
