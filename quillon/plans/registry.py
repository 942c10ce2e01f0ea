"""Queries of the matrix engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions import text
from quillon.operators import differential as diff
from quillon.operators import fitted, policy, written
from quillon.operators import matrix as mx
from quillon.operators import profile as pf
from quillon.operators import reduce as rd
from quillon.operators import resample as rs
from quillon.operators import select as sl
from quillon.operators import sets as st
from quillon.sources import bridge, vendor

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

A, B = "ASIA", "EUROPE"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


SAMPLES_SQL = """samples as (select distinct n_name as sample, r_name as grp, n_nationkey as sample_ord, r_regionkey as group_ord
  from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey)"""
QUANT_SQL = f"""with {SAMPLES_SQL},
q as (select printf('P%07d', l_partkey) as feature_id, n_name as sample, r_name as grp, cast(sum(cast(l_extendedprice as decimal(18,2))) as double) as value,
    nullif(count(*) filter (where l_returnflag <> 'R'), 0) as ident
  from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by all)"""
DENSE_SQL = QUANT_SQL + """,
d as (select f.feature_id, s.sample, s.grp, q.value, q.ident, case when q.value > -1 then log2(q.value + 1) end as x
  from (select distinct feature_id from q) f cross join samples s left join q on q.feature_id = f.feature_id and q.sample = s.sample)"""


def prepared_sql(share: float) -> str:
    return DENSE_SQL + f""",
k as (select *, count(x) over (partition by feature_id) as have, count(*) over (partition by feature_id) as n from d),
p as (select feature_id, sample, grp, value, x as raw_x, coalesce(x, median(x) over (partition by feature_id)) as x from k where have >= greatest(1, ceil(n * {share})))"""


def quant(s, d):
    return bridge.quant(s, d)


def dense(s, d):
    return mx.dense(bridge.quant(s, d), bridge.samples(s, d))


def prepared(s, d, share):
    return mx.prepared(dense(s, d), share)


@query(QUANT_SQL + " select feature_id, sample, grp, value, ident from q")
def quant_matrix_long(s, d):
    return quant(s, d)


@query(DENSE_SQL + " select feature_id, count(value) as valid, count(*) - count(value) as missing, round(sum(value), 2) as total from d group by all")
def dense_missingness(s, d):
    v = F.count("value")
    return dense(s, d).groupBy("feature_id").agg(v.alias("valid"), (F.count(F.lit(1)) - v).alias("missing"), F.round(F.sum(F.col("value").cast("decimal(18,2)")).cast("double"), 2).alias("total"))


@query(f"""with {SAMPLES_SQL}, z as (select l_partkey, n_name as sample, sum(case when l_discount = 0 then 0 else cast(l_extendedprice as decimal(18,2)) end) as v
  from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey group by all)
select sample, count(*) as cells, count(*) filter (where v = 0) as raw_zeros, count(nullif(v, 0)) as available from z group by sample""")
def zero_as_missing(s, d):
    """A matrix whose zeros mean missing: converted cells and what is left."""
    lines = bridge.table(s, d, "lineitem").select("l_partkey", "l_suppkey", "l_discount", "l_extendedprice")
    sup = bridge.table(s, d, "supplier").select("s_suppkey", "s_nationkey")
    nation = bridge.table(s, d, "nation").select("n_nationkey", F.col("n_name").alias("sample"))
    v = F.sum(F.when(F.col("l_discount") == 0, F.lit(0)).otherwise(F.col("l_extendedprice").cast("decimal(18,2)")))
    z = lines.join(sup, lines.l_suppkey == sup.s_suppkey).groupBy("l_partkey", "s_nationkey").agg(v.alias("raw_value")).join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey"))
    cells = z.select(F.col("l_partkey").alias("feature_id"), "sample", "raw_value", vendor.without_zeros(F.col("raw_value"), vendor.ZeroMode.MISSING).alias("value"), F.lit(False).alias("is_explicit_missing"))
    return vendor.counters(cells, "sample").select("sample", "cells", "raw_zeros", "available")


@query(DENSE_SQL + " select count(distinct feature_id) as features, count(distinct sample) as samples, count(distinct grp) as groups, count(*) as cells, count(value) as available, count(*) - count(value) as missing, count(*) filter (where value = 0) as zeros from d")
def input_summary(s, d):
    cells = dense(s, d).select("feature_id", "sample", F.col("value").alias("raw_value"), "value", F.lit(False).alias("is_explicit_missing"))
    groups = bridge.samples(s, d).agg(F.count_distinct("grp").alias("groups"))
    return vendor.counters(cells).join(F.broadcast(groups)).select("features", "samples", "groups", "cells", "available", "missing", F.col("raw_zeros").alias("zeros"))


@query(prepared_sql(0.3) + " select feature_id, sample, round(x, 6) as x from p")
def prepared_matrix_30(s, d):
    return prepared(s, d, 0.3).select("feature_id", "sample", F.round("x", 6).alias("x"))


@query(prepared_sql(0.5) + " select feature_id, sample, round(x, 6) as x from p")
def prepared_matrix_50(s, d):
    return prepared(s, d, 0.5).select("feature_id", "sample", F.round("x", 6).alias("x"))


@query(prepared_sql(0.5) + " select feature_id, sample, round(raw_x, 6) as x from p")
def stability_input(s, d):
    """Filtered but not imputed."""
    return mx.filtered(dense(s, d), 0.5).select("feature_id", "sample", F.round("x", 6).alias("x"))


@query(QUANT_SQL + " select sample, grp, count(ident) as identified_protein_count, count(value) as quantified_protein_count from q group by all")
def sample_counts(s, d):
    return pf.sample_counts(quant(s, d))


@query(QUANT_SQL + ", c as (select sample, grp, count(value) as n from q group by all) select grp, round(avg(n), 6) as mean, round(stddev_samp(n), 6) as sd, count(n) as n from c group by grp")
def group_count_summary(s, d):
    return pf.group_counts(pf.sample_counts(quant(s, d)), "quantified_protein_count")


_QC = "count(*) as {n}, count(value) as {q}, count(*) - count(value) as {m}, round((count(*) - count(value)) * 100.0 / count(*), 6) as missing_percent, round(median(x), 6) as median_log2_abundance, round(avg(x), 6) as mean_log2_abundance"


@query(DENSE_SQL + " select sample, grp, " + _QC.format(n="total_proteins", q="quantified_proteins", m="missing_values") + " from d group by all")
def qc_sample_summary(s, d):
    return pf.qc_samples(dense(s, d))


@query(DENSE_SQL + " select feature_id, " + _QC.format(n="total_samples", q="quantified_samples", m="missing_samples") + " from d group by all")
def qc_protein_summary(s, d):
    return pf.qc_features(dense(s, d))


@query(DENSE_SQL + " select feature_id, grp, count(value) as quantified_n, count(*) as total_n, round(count(value) * 100.0 / count(*), 6) as quantified_percent from d group by all")
def qc_protein_group(s, d):
    return pf.qc_feature_groups(dense(s, d))


@query(DENSE_SQL + """, m as (select feature_id, count(*) - count(value) as k, count(*) as n from d group by all)
select l as missing_samples, count(k) as proteins, round(count(k) * 100.0 / (select count(*) from m), 6) as percent from generate_series(0, (select max(n) from m)) g(l) left join m on m.k = l group by l""")
def qc_missing_histogram(s, d):
    return pf.qc_histogram(dense(s, d))


@query(DENSE_SQL + """ select feature_id, round((count(*) - count(value)) * 100.0 / count(*), 6) as missing_percent from d group by feature_id having count(value) > 0 and count(value) < count(*)
order by 2 desc, 1 limit 200""")
def qc_heatmap_top(s, d):
    return pf.qc_heatmap_top(dense(s, d))


_RANK = " select feature_id, sample, grp, value, row_number() over (partition by sample order by value desc, feature_id) as rank, round({f}(value + 1), 6) as transformed from q"


@query(QUANT_SQL + _RANK.format(f="log10"))
def rank_abundance_log10(s, d):
    return pf.rank_abundance(quant(s, d), "log10")


@query(QUANT_SQL + _RANK.format(f="log2"))
def rank_abundance_log2(s, d):
    return pf.rank_abundance(quant(s, d), "log2")


_CV = QUANT_SQL + ", v as (select feature_id, grp, round(100 * stddev_samp(value) / avg(value), 6) as cv from q group by all having count(value) >= 2 and avg(value) > 0)"


@query(_CV + " select feature_id, grp, cv from v")
def cv_values(s, d):
    return pf.variation(quant(s, d))


@query(_CV + " select grp, round(median(cv), 6) as median_cv from v where cv between 0 and 60 group by grp")
def cv_median(s, d):
    return pf.median_variation(quant(s, d))


_PEARSON = prepared_sql(0.3) + ", c as (select a.sample as sample1, b.sample as sample2, round(corr(a.x, b.x), 6) + 0.0 as correlation from p a join p b using (feature_id) group by all)"


@query(_PEARSON + " select * from c")
def correlation_pearson(s, d):
    return pf.correlation(prepared(s, d, 0.3), bridge.samples(s, d))


@query(prepared_sql(0.3) + """, r as (select feature_id, sample, cast(rank() over (partition by sample order by x) + (count(*) over (partition by sample, x) - 1) / 2.0 as double) as x from p)
select a.sample as sample1, b.sample as sample2, round(corr(a.x, b.x), 6) as correlation from r a join r b using (feature_id) group by all""")
def correlation_spearman(s, d):
    return pf.correlation(prepared(s, d, 0.3), bridge.samples(s, d), "spearman")


@query(_PEARSON + """, o as (select sample, grp, row_number() over (order by group_ord, sample_ord) as place from samples)
select c.sample1, c.sample2, c.correlation, a.grp as group1, a.place as ordered1, b.grp as group2, b.place as ordered2 from c join o a on a.sample = sample1 join o b on b.sample = sample2""")
def correlation_group_order(s, d):
    own = bridge.samples(s, d)
    return pf.in_group_order(pf.correlation(prepared(s, d, 0.3), own), own)


GROUPS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
_SETS = QUANT_SQL + ", g as (select grp, feature_id, count(ident) as replicates from q group by all having count(ident) >= 2)"
_FLAG = "cast(max(case when grp = '{g}' then 1 else 0 end) as integer)"


def sets(s, d):
    return st.group_sets(quant(s, d), 2)


@query(_SETS + " select grp, feature_id, replicates from g")
def group_sets(s, d):
    return sets(s, d)


@query(_SETS + " select feature_id, " + ", ".join(f"{_FLAG.format(g=g)} as {g.lower().replace(' ', '_')}" for g in GROUPS) + " from g group by feature_id")
def set_membership(s, d):
    return st.membership(sets(s, d), GROUPS)


@query(_SETS + ", c as (select feature_id, " + " || ".join(f"cast({_FLAG.format(g=g)} as varchar)" for g in GROUPS) + " as combo from g group by feature_id) select combo, count(*) as proteins from c group by combo")
def set_intersections(s, d):
    return st.compared(sets(s, d), GROUPS)


_ANN = _SETS + ", a as (select printf('P%07d', p_partkey) as accession, cast(p_size as integer) as length, p_retailprice as mw, p_type as subcellular_class, cast(p_size % 5 as integer) as tm_helices from part where p_partkey % 10 <> 0), l as (select g.grp, g.feature_id as accession, a.* exclude (accession) from g left join a on a.accession = g.feature_id)"


@query(_ANN + " select * from l")
def annotation_long(s, d):
    return st.annotated(sets(s, d), bridge.annotations(s, d)).select("grp", "accession", "length", "mw", "subcellular_class", "tm_helices")


@query(_ANN + " select grp, count(*) as queried, count(length) as matched, count(*) - count(length) as unmatched, round(100.0 * count(length) / count(*), 6) as match_percent from l group by grp")
def annotation_coverage(s, d):
    return st.coverage(sets(s, d), bridge.annotations(s, d))


@query(_ANN + """, t as (select grp, case when tm_helices >= 3 then '>=3' else cast(tm_helices as varchar) end as c from l where tm_helices is not null),
n as (select g.grp, k.c as tm_category, (select count(*) from t where t.grp = g.grp and t.c = k.c) as protein_count from (select distinct grp from t) g cross join (values ('0'), ('1'), ('2'), ('>=3')) k(c))
select *, cast(sum(protein_count) over (partition by grp) as bigint) as denominator, round(protein_count / cast(sum(protein_count) over (partition by grp) as double), 6) as proportion from n""")
def tm_category_proportions(s, d):
    return st.tm_proportions(st.annotated(sets(s, d), bridge.annotations(s, d)))


@query(_ANN + """, n as (select grp, subcellular_class, count(*) as n from l where subcellular_class <> '' group by all), m as (select *, cast(sum(n) over (partition by grp) as bigint) as denominator from n)
select *, round(n / cast(denominator as double), 6) as proportion, case when n / cast(denominator as double) >= 0.06 then printf('%.1f%%', round(n * 100 / cast(denominator as double), 1)) else '' end as label from m""")
def subcellular_proportions(s, d):
    return st.class_proportions(st.annotated(sets(s, d), bridge.annotations(s, d)))


_TWO = DENSE_SQL + f""", s as (select feature_id, count(x) filter (where grp = '{A}') as n_a, count(x) filter (where grp = '{B}') as n_b, avg(x) filter (where grp = '{A}') as mean_a, avg(x) filter (where grp = '{B}') as mean_b,
  var_samp(x) filter (where grp = '{A}') as var_a, var_samp(x) filter (where grp = '{B}') as var_b, avg(value) filter (where grp = '{A}') as raw_a, avg(value) filter (where grp = '{B}') as raw_b
  from d where grp in ('{A}', '{B}') group by feature_id having count(value) > 0)"""


@query(_TWO + " select feature_id, round(mean_a, 6) as mean_a_log2, round(mean_b, 6) as mean_b_log2, round(mean_b - mean_a, 6) as log2fc_logmean, round(case when raw_b / raw_a > 0 then log2(raw_b / raw_a) end, 6) as log2fc_ratio from s")
def volcano_fold_change(s, d):
    return diff.fold_change(diff.two_groups(quant(s, d), A, B))


_WELCH = _TWO + ", w as (select *, var_a / n_a + var_b / n_b as se2 from s where n_a >= 2 and n_b >= 2), t as (select feature_id, (mean_b - mean_a) / sqrt(se2) as t, se2 ** 2 / ((var_a / n_a) ** 2 / (n_a - 1) + (var_b / n_b) ** 2 / (n_b - 1)) as df from w where se2 > 0)"


@query(_WELCH + " select feature_id, round(t, 6) as t, round(df, 6) as df from t")
def volcano_welch_stat(s, d):
    return diff.welch(diff.two_groups(quant(s, d), A, B)).select("feature_id", F.round("t", 6).alias("t"), F.round("df", 6).alias("df"))


def _volcano(s, tests, p_name):
    fc = diff.fold_change(s)
    tests = diff.adjusted(tests.withColumn("p", diff.p_value("t", "df")))
    return fc.join(tests, "feature_id", "left").select("feature_id", "log2fc_logmean", F.round("t", 6).alias("t"), F.round("p", 9).alias("p_value"), F.round("q", 9).alias("adjusted_p"), diff.regulation(F.col("log2fc_logmean"), F.col("p")).alias("regulation"), F.lit(p_name).alias("method"))


@query()
def volcano_welch_p(s, d):
    g = diff.two_groups(quant(s, d), A, B)
    return _volcano(g, diff.welch(g), "welch")


@query()
def volcano_moderated(s, d):
    g = diff.two_groups(quant(s, d), A, B)
    return _volcano(g, diff.moderated(g), "moderated")


@query(_WELCH + ", p as (select feature_id, round(1 / (1 + abs(t) * sqrt(df)), 9) as p from t), r as (select *, row_number() over (order by p, feature_id) as i, count(*) over () as n from p) select feature_id, p, round(least(1.0, min(p * n / i) over (order by p desc, feature_id desc rows unbounded preceding)), 9) as q from r")
def bh_adjust(s, d):
    """Adjustment of a stand-in p that both engines can state."""
    w = diff.welch(diff.two_groups(quant(s, d), A, B)).select("feature_id", F.round(1 / (1 + F.abs("t") * F.sqrt("df")), 9).alias("p"))
    return diff.adjusted(w).select("feature_id", "p", F.round("q", 9).alias("q"))


@query(prepared_sql(0.5) + ", v as (select feature_id, round(var_samp(x), 9) as variance from p group by feature_id), b as (select * from v order by variance desc, feature_id limit 100) select p.feature_id, p.sample, round(coalesce((x - avg(x) over f) / nullif(stddev_samp(x) over f, 0), 0), 6) as z from p join b using (feature_id) window f as (partition by p.feature_id)")
def heatmap_zscore_topvar(s, d):
    z = mx.z_scores(mx.top_variance(prepared(s, d, 0.5), 100))
    return z.select("feature_id", "sample", F.round("z", 6).alias("z"))


@query("""with r as (select *, row_number() over (partition by o_custkey order by case when o_orderpriority = '1-URGENT' then 0 else 1 end, o_orderkey) as n from orders) select o_custkey, o_orderkey, o_orderpriority from r where n = 1""")
def representative_row(s, d):
    """The first marked row of each group, else its first."""
    orders = bridge.table(s, d, "orders").select("o_custkey", "o_orderkey", "o_orderpriority")
    return vendor.representative(orders, "o_custkey", F.col("o_orderpriority") == "1-URGENT", "o_orderkey")


@query("select l_orderkey, l_linenumber, cast(l_partkey as varchar) || case when n > 0 then '.' || n else '' end as analysis_id from (select *, row_number() over (partition by l_partkey order by l_orderkey, l_linenumber) - 1 as n from lineitem)")
def unique_suffix(s, d):
    """Repeated identifiers made unique by a running number."""
    t = bridge.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").cast("string").alias("id"))
    return text.unique_ids(t, "id", ["l_orderkey", "l_linenumber"], "analysis_id").drop("id")


@query(f"with {SAMPLES_SQL} select sample, lower(substr(grp, 1, 3)) || '-' || row_number() over (partition by grp order by sample_ord) as short_name from samples")
def short_sample_names(s, d):
    return text.short_names(bridge.samples(s, d), F.lower(F.substring("grp", 1, 3)), ["sample_ord"]).select("sample", "short_name")


@query("select l_returnflag, count(*) as rows from lineitem where coalesce(trim(l_returnflag), '') not in ('R', '+', 'TRUE', 'True', 'true', '1') group by all")
def contaminant_filter(s, d):
    lines = bridge.table(s, d, "lineitem").filter(vendor.unmarked("l_returnflag", ("R", *vendor._YES)))
    return lines.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("rows"))


@query("""with i as (select c_custkey, 'sp|Q' || lpad(cast(c_custkey as varchar), 6, '0') || '|' || upper(c_mktsegment) || '_X extra;other' as raw from customer)
select c_custkey, regexp_extract(raw, '^(?:sp|tr)\\|([^|]+)', 1) as accession, regexp_extract(raw, '^(?:sp|tr)\\|[^|]+\\|([^| ]+)', 1) as entry_name, trim(split_part(raw, ';', 1)) as first_value from i""")
def clean_accession(s, d):
    raw = F.concat(F.lit("sp|Q"), F.lpad(F.col("c_custkey").cast("string"), 6, "0"), F.lit("|"), F.upper("c_mktsegment"), F.lit("_X extra;other"))
    return bridge.table(s, d, "customer").select("c_custkey", text.clean_accession(raw).alias("accession"), text.entry_name(raw).alias("entry_name"), text.take_first(raw).alias("first_value"))


_Y = "with y as (select vec_id as id, cast(label as varchar) as y from embeddings) "


def labelled(s, d):
    return bridge.table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("y"))


@query(_Y + "select id, y, (row_number() over (partition by y order by md5('123|' || id), id) - 1) % 5 + 1 as fold from y")
def stratified_folds(s, d):
    return rs.folds(labelled(s, d), 5)


@query(_Y + "select id, y, case when row_number() over (partition by y order by md5('123|' || id), id) <= greatest(1, least(count(*) over (partition by y) - 1, ceil(count(*) over (partition by y) * 0.7))) then 'train' else 'test' end as part from y")
def train_test_split(s, d):
    return rs.train_test(labelled(s, d))


@query(_Y + "select repeat, id, y, case when row_number() over (partition by repeat, y order by md5((repeat + 122) || '|' || id), id) <= least(count(*) over (partition by repeat, y) - 1, ceil(count(*) over (partition by repeat, y) * 0.8)) then 'train' else 'test' end as part from (select *, cast(unnest(generate_series(1, 5)) as integer) as repeat from y)")
def split_plan(s, d):
    return rs.split_plan(labelled(s, d), 5)


_PRED = "with pr as (select vec_id, cast(label % 3 as varchar) as actual, cast(cast(floor(abs(embedding[1]) * 100) as bigint) % 3 as varchar) as predicted, round(cast(embedding[2] as double), 3) as score from embeddings) "


def predictions(s, d):
    """A rule's predictions, which both engines can state."""
    e = bridge.table(s, d, "embeddings")
    rule = F.floor(F.abs(F.col("embedding")[0]) * F.lit(100).cast("float")).cast("long") % 3
    return e.select("vec_id", (F.col("label") % 3).cast("string").alias("actual"), rule.cast("string").alias("predicted"), F.round(F.col("embedding")[1].cast("double"), 3).alias("score"))


@query(_PRED + "select actual, predicted, count(*) as n from pr group by all")
def confusion_matrix(s, d):
    return rs.confusion(predictions(s, d))


_METRICS = _PRED + """, c as (select distinct actual as class from pr union select distinct predicted from pr),
m as (select class, count(*) filter (where actual = class and predicted = class) as tp, count(*) filter (where actual <> class and predicted = class) as fp, count(*) filter (where actual <> class and predicted <> class) as tn,
  count(*) filter (where actual = class and predicted <> class) as fn from c cross join pr group by class),
r as (select *, round(tp / nullif(tp + fn, 0), 6) as sensitivity, round(tn / nullif(tn + fp, 0), 6) as specificity, round(tp / nullif(tp + fp, 0), 6) as precision, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) as f1 from m)"""


@query(_METRICS + " select * from r")
def class_metrics(s, d):
    return rs.class_metrics(predictions(s, d))


@query(_METRICS + " select (select round(avg(case when actual = predicted then 1.0 else 0 end), 6) from pr) as accuracy, round(avg(sensitivity), 6) as macro_sensitivity, round(avg(specificity), 6) as macro_specificity, round(avg(precision), 6) as macro_precision, round(avg(f1), 6) as macro_f1 from r")
def macro_summary(s, d):
    return rs.summary(predictions(s, d))


_BY = _PRED + ", b as (select score, count(*) filter (where actual = '1') as p, count(*) filter (where actual <> '1') as q from pr group by score)"


@query(_BY + " select score as threshold, round(sum(p) over (order by score desc) / cast(sum(p) over () as double), 6) as tpr, round(sum(q) over (order by score desc) / cast(sum(q) over () as double), 6) as fpr from b")
def roc_curve(s, d):
    return rs.roc(predictions(s, d), "1")


@query(_BY + ", c as (select *, coalesce(sum(q) over (order by score rows between unbounded preceding and 1 preceding), 0) as below from b) select round(sum((below + q / 2.0) * p) / cast(sum(p) * sum(q) as double), 6) as auc from c")
def roc_auc(s, d):
    return rs.auc(predictions(s, d), "1")


def half_prepared(s, d):
    """Profiles of the features that half of the samples hold, and the samples."""
    own = bridge.samples(s, d)
    return mx.profiles(quant(s, d), own, 0.5), own


@query()
def pca_scores(s, d):
    return rd.pca(*half_prepared(s, d))


@query()
def pca_variance(s, d):
    return rd.pca_variance(*half_prepared(s, d))


@query()
def tsne_coordinates(s, d):
    return rd.tsne(*half_prepared(s, d))


@query()
def umap_coordinates(s, d):
    return rd.umap(*half_prepared(s, d))


@query()
def heatmap_sample_clusters(s, d):
    return rd.sample_clusters(*half_prepared(s, d))


@query()
def heatmap_feature_kmeans(s, d):
    return rd.feature_kmeans(mx.top_variance(prepared(s, d, 0.5), 100))


@query()
def correlation_clusters(s, d):
    return rd.correlation_clusters(pf.correlation(prepared(s, d, 0.3), bridge.samples(s, d)))


@query()
def pseudotime(s, d):
    return rd.pseudotime(*half_prepared(s, d), "AFRICA")


@query(prepared_sql(0.5) + """, c as (select feature_id, round(x, 9) as x, cast(sample_ord as double) as t from p join samples using (sample)),
r as (select feature_id, x, cast(rank() over (partition by feature_id order by x) + (count(*) over (partition by feature_id, x) - 1) / 2.0 as double) as rx,
  cast(rank() over (partition by feature_id order by t) + (count(*) over (partition by feature_id, t) - 1) / 2.0 as double) as rt from c)
select feature_id, round(corr(rx, rt), 6) as rho from r group by feature_id having count(distinct x) > 2 and not isnan(corr(rx, rt))""")
def order_spearman(s, d):
    """Features along a given order of samples."""
    order = bridge.samples(s, d).select("sample", F.col("sample_ord").cast("double").alias("t"))
    return rd.profile_correlation(*half_prepared(s, d), order).select("feature_id", F.round("rho", 6).alias("rho"))


@query()
def pseudotime_spearman(s, d):
    p, own = half_prepared(s, d)
    p = written.once(p, "profiles")  # read for the order, then along it
    order = rd.pseudotime(p, own, "AFRICA").filter("lineage = 1").select("sample", F.col("pseudotime").alias("t"))
    r = written.once(rd.profile_correlation(p, own, order), "rank_correlation")
    return diff.adjusted(r).select("feature_id", F.round("rho", 6).alias("rho"), F.round("p", 9).alias("p"), F.round("q", 9).alias("q"))


def _stability(s, d, repeats=50):
    """Five samples a group are enough for an exploratory selection; with fewer there are no rows."""
    f = mx.filtered(dense(s, d), 0.5)
    try:
        fits = sl.fits(f, bridge.samples(s, d), repeats, exploratory=True)
    except policy.PolicyError:
        fits = s.createDataFrame([], "repeat int, feature_id string, gini double, gini_rank long, l1 double, forest_accuracy double, l1_accuracy double")
    return sl.stability(fits, f, repeats)


@query()
def rf_stability(s, d):
    return sl.ranked(_stability(s, d), "forest_score")


@query()
def l1_stability(s, d):
    return sl.ranked(_stability(s, d), "l1_frequency")


@query()
def combined_score(s, d):
    return sl.ranked(_stability(s, d), "combined_score")


@query()
def feature_union(s, d):
    t = _stability(s, d)
    return sl.union_of([("rf", sl.ranked(t, "forest_score")), ("l1", sl.ranked(t, "l1_frequency")), ("rfl1", sl.ranked(t, "combined_score"))])


_VOLCANO = """, v as (select s.feature_id, mean_a, mean_b, raw_a, raw_b, mean_b - mean_a as fc, round(1 / (1 + abs(t) * sqrt(df)), 9) as sig from s left join t using (feature_id))"""


@query(_WELCH + _VOLCANO + " select feature_id, round(mean_a, 6) as mean_a, round(log2(raw_b), 6) as log2_raw_b, round(fc, 6) as log2fc, round(-log10(sig), 6) as minus_log10, case when sig < 0.2 and fc >= 0.1 then 'Up' when sig < 0.2 and fc <= -0.1 then 'Down' else 'NotSig' end as regulation from v")
def volcano_regulation(s, d):
    """Labels by a stand-in p that both engines can state."""
    g = diff.two_groups(quant(s, d), A, B)
    w = diff.welch(g).select("feature_id", F.round(1 / (1 + F.abs("t") * F.sqrt("df")), 9).alias("sig"))
    v = g.join(w, "feature_id", "left").withColumn("fc", F.col("mean_b") - F.col("mean_a"))
    return v.select("feature_id", F.round("mean_a", 6).alias("mean_a"), F.round(F.log2("raw_b"), 6).alias("log2_raw_b"), F.round("fc", 6).alias("log2fc"), F.round(diff.minus_log10("sig"), 6).alias("minus_log10"), diff.regulation(F.col("fc"), F.col("sig"), 0.2, 0.1).alias("regulation"))


@query()
def volcano_table(s, d):
    """All columns of the volcano result; its p-values need the t distribution."""
    v = diff.volcano(quant(s, d), A, B, metric="adj_p")
    return v.select(*[F.col(f"`{c}`").alias(c.replace(".", "_")) for c in v.columns])


@query(_TWO + """, m as (select *, n_a + n_b - 2 as dd, ((n_a - 1) * coalesce(var_a, 0) + (n_b - 1) * coalesce(var_b, 0)) / (n_a + n_b - 2) as s2 from s where n_a >= 1 and n_b >= 1 and n_a + n_b > 2)
select feature_id, round((mean_b - mean_a) / sqrt((4.0 * 0.05 + dd * s2) / (4.0 + dd) * (1.0 / n_a + 1.0 / n_b)), 6) as t, cast(dd + 4.0 as double) as df from m""")
def moderated_statistic(s, d):
    """With a given prior of 4 degrees of freedom and a variance of 0.05."""
    return diff.moderated_statistic(diff.two_groups(quant(s, d), A, B), 4.0, 0.05).select("feature_id", F.round("t", 6).alias("t"), "df")


@query(_PRED + ", f as (select vec_id % 5 as fold, * from pr), r as (select fold, actual, avg(case when actual = predicted then 1.0 else 0 end) as recall from f group by all) select fold, round(avg(recall), 6) as balanced_accuracy from r group by fold")
def balanced_accuracy(s, d):
    return rs.balanced_accuracy(predictions(s, d).withColumn("fold", F.col("vec_id") % 5), "fold")


@query("select vec_id, case list_position(l, list_max(l)) when 1 then 'A' when 2 then 'B' else 'C' end as class from (select vec_id, [round(cast(embedding[i] as double), 1) for i in [1, 2, 3]] as l from embeddings)")
def argmax_class(s, d):
    """The first of the largest of three scores, rounded so that some are equal."""
    scores = F.array(*[F.round(F.col("embedding")[i].cast("double"), 1) for i in range(3)])
    return bridge.table(s, d, "embeddings").select("vec_id", rs.likeliest(scores, ["A", "B", "C"]).alias("class"))


@query(f"with {SAMPLES_SQL}, o as (select grp, row_number() over (order by group_ord, sample_ord) as place from samples), g as (select place as gap, grp, lead(grp) over (order by place) as nxt from o) select gap from g where nxt <> grp")
def group_gaps(s, d):
    """Where a drawing of samples in group order is cut."""
    return pf.gaps(bridge.samples(s, d).withColumn("place", F.struct("group_ord", "sample_ord")), "grp", "place")


@query(QUANT_SQL + ", c as (select sample, grp, count(value) as quantified_protein_count from q group by all), m as (select sample, grp, sample_ord from samples where sample_ord % 3 > 0) select c.sample, c.grp, quantified_protein_count, sample_ord from c left join m on m.sample = c.sample and m.grp = c.grp")
def counts_with_metadata(s, d):
    metadata = bridge.samples(s, d).filter("sample_ord % 3 > 0").select("sample", "grp", "sample_ord")
    return vendor.with_metadata(pf.sample_counts(quant(s, d)).drop("identified_protein_count"), metadata)


@query(QUANT_SQL + ", m as (select sample, 'S' || sample_ord as shown from samples where sample_ord < 15) select feature_id, shown as sample, value from q join m using (sample)")
def display_names(s, d):
    names = bridge.samples(s, d).filter("sample_ord < 15").select("sample", F.concat(F.lit("S"), F.col("sample_ord").cast("string")).alias("display_name"))
    return vendor.displayed(quant(s, d), names).select("feature_id", "sample", "value")


_TRAIN = DENSE_SQL + """,
k as (select *, count(x) over (partition by feature_id) as have, count(*) over (partition by feature_id) as n from d), fx as (select feature_id, sample, x from k where have >= greatest(1, ceil(n * 0.5))),
rep as (select *, cast(unnest(generate_series(1, 5)) as integer) as repeat from samples),
pl as (select repeat, sample, row_number() over (partition by repeat, grp order by md5((repeat + 122) || '|' || sample), sample) as place, count(*) over (partition by repeat, grp) as n from rep),
tv as (select repeat, feature_id, round(var_samp(x), 9) as variance, round(median(x), 6) as fill from fx join pl using (sample) where place <= least(n - 1, ceil(n * 0.8)) group by all having var_samp(x) is not null),
top as (select *, row_number() over (partition by repeat order by variance desc, feature_id) as place from tv)"""


def top_in_training(s, d):
    own = bridge.samples(s, d)
    return sl.top_in_training(mx.filtered(dense(s, d), 0.5), sl.training_plan(own, 5), 50)


@query(_TRAIN + " select repeat, feature_id, round(variance, 6) as variance from top where place <= 50")
def train_variance_topn(s, d):
    return top_in_training(s, d).select("repeat", "feature_id", F.round("variance", 6).alias("variance"))


@query(_TRAIN + " select repeat, feature_id, fill from top where place <= 50")
def train_median_impute(s, d):
    return top_in_training(s, d).select("repeat", "feature_id", "fill")


_FITS = """with f as (select printf('P%07d', p_partkey) as feature_id, repeat, row_number() over (partition by repeat order by md5(repeat || '|' || p_partkey), p_partkey) as gini_rank
  from part, (select cast(unnest(generate_series(1, 5)) as integer) as repeat)), r as (select *, round(1.0 / gini_rank, 9) as gini from f where gini_rank <= 200),
p as (select feature_id, count(*) filter (where gini_rank <= 20) / 5.0 as t20, count(*) filter (where gini_rank <= 50) / 5.0 as t50, sum(cast(gini as decimal(18,9))) / 5.0 as mg, count(*) filter (where gini_rank % 7 = 0) / 5.0 as l1 from r group by feature_id),
a as (select u.feature_id, coalesce(t20, 0) as t20, coalesce(t50, 0) as t50, cast(coalesce(mg, 0) as double) as mg, coalesce(l1, 0) as l1 from (select printf('P%07d', p_partkey) as feature_id from part) u left join p using (feature_id)),
z as (select *, (mg - min(mg) over ()) / nullif(max(mg) over () - min(mg) over (), 0) as g from a)"""


def rule_fits(s, d):
    """Ranks that a hash gives, in the place of fitted ones."""
    each = bridge.table(s, d, "part").select("p_partkey", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("repeat"))
    each = each.withColumn("h", F.md5(F.concat_ws("|", "repeat", "p_partkey"))).withColumn("part_", F.pmod(F.hash("p_partkey"), F.lit(sl.PARTS)))
    for keys in (["repeat", "part_"], ["repeat"]):
        each = each.withColumn("gini_rank", F.row_number().over(Window.partitionBy(*keys).orderBy("h", "p_partkey"))).filter("gini_rank <= 200")
    return each.select(bridge.feature_id("p_partkey").alias("feature_id"), "repeat", "gini_rank", F.round(1 / F.col("gini_rank"), 9).alias("gini"), (F.col("gini_rank") % 7 == 0).cast("double").alias("l1"))


def rule_scores(s, d):
    return sl.stability(rule_fits(s, d), bridge.table(s, d, "part").select(bridge.feature_id("p_partkey").alias("feature_id")), 5)


@query(_FITS + " select feature_id, round(t20, 6) as top20_frequency, round(t50, 6) as top50_frequency, round(l1, 6) as l1_frequency, round(g, 6) as gini_scaled, round(0.35 * t20 + 0.25 * t50 + 0.30 * l1 + 0.10 * g, 6) as combined_score from z")
def score_arithmetic(s, d):
    return rule_scores(s, d).select("feature_id", *(F.round(c, 6).alias(c) for c in ("top20_frequency", "top50_frequency", "l1_frequency", "gini_scaled", "combined_score")))


_SPLIT = """with q as (select printf('P%07d', p_partkey) as feature_id, translate(md5(cast(p_partkey as varchar)), '0123456789abcdef', 'ACDEFGHIKLMNPQRS') as sequence from part)"""


@query(_SPLIT + " select feature_id, cast(length(sequence) as integer) as length, round(cast((" + " + ".join(f"{v} * (length(sequence) - length(replace(sequence, '{k}', '')))" for k, v in text.HYDROPATHY.items()) + ") as double) / length(sequence), 6) as gravy, round(cast(" + " + ".join(f"{v} * (length(sequence) - length(replace(sequence, '{k}', '')))" for k, v in text.MASS.items()) + f" + {text.WATER} as double), 4) as mw from q")
def protein_properties(s, d):
    """Length, hydropathy and mass of sequences that a hash of the part gives."""
    seq = F.translate(F.md5(F.col("p_partkey").cast("string").cast("binary")), "0123456789abcdef", "ACDEFGHIKLMNPQRS")
    q = bridge.table(s, d, "part").select(bridge.feature_id("p_partkey").alias("feature_id"), seq.alias("sequence"))
    return q.select("feature_id", F.length(text.clean_sequence(F.col("sequence"))).alias("length"), F.round(text.gravy(F.col("sequence")), 6).alias("gravy"), F.round(text.molecular_weight(F.col("sequence")), 4).alias("mw"))


@query(prepared_sql(0.5) + """, c as (select feature_id, round(x, 9) as x, cast(sample_ord as double) as t from p join samples using (sample)),
r as (select feature_id, x, cast(rank() over (partition by feature_id order by x) + (count(*) over (partition by feature_id, x) - 1) / 2.0 as double) as rx,
  cast(rank() over (partition by feature_id order by t) + (count(*) over (partition by feature_id, t) - 1) / 2.0 as double) as rt from c),
o as (select feature_id, round(corr(rx, rt), 6) as rho from r group by feature_id having count(distinct x) > 2 and not isnan(corr(rx, rt)))
select feature_id, rho from o order by round(1 - abs(rho), 1), abs(rho) desc, feature_id limit 100""")
def association_order(s, d):
    """The features most associated with a given order, by a stand-in q that both engines can state."""
    return rd.by_association(order_spearman(s, d).withColumn("q", F.round(1 - F.abs("rho"), 1)), 100).select("feature_id", "rho")


@query(DENSE_SQL + " select feature_id, sample, value is null as is_missing, count(value) over (partition by feature_id) as valid from d")
def missing_cells(s, d):
    return pf.missing_cells(dense(s, d))


@query(DENSE_SQL + " select feature_id, " + _QC.format(n="total_samples", q="quantified_samples", m="missing_samples") + ", " + ", ".join(f"""count(value) filter (where grp = '{g}') as "{g.replace(' ', '.')}_Quantified_N", count(*) filter (where grp = '{g}') as "{g.replace(' ', '.')}_Total_N", round(count(value) filter (where grp = '{g}') * 100.0 / nullif(count(*) filter (where grp = '{g}'), 0), 6) as "{g.replace(' ', '.')}_Quantified_Percent" """ for g in GROUPS) + " from d group by feature_id")
def qc_protein_wide(s, d):
    """A row a protein, with the counts and percentage of each group in columns."""
    return pf.qc_features_wide(dense(s, d), GROUPS)


def vectors_of(s, d):
    """(id, y, features) of the embeddings, in two classes that three of the dimensions decide."""
    e = bridge.table(s, d, "embeddings")
    x = [F.col("embedding")[i].cast("double") for i in range(3)]
    return e.select(F.col("vec_id").alias("id"), F.when(x[0] + x[1] - x[2] > 0, "1").otherwise("0").alias("y"), fitted.array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))


def vector_places(s, d):
    """(feature_id, i): names of the embeddings' dimensions."""
    one = bridge.table(s, d, "embeddings").agg(F.max(F.size("embedding")).alias("n")).filter("n > 0")
    return one.select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("n").cast("long") - 1)).alias("i")).select(F.concat(F.lit("E"), F.lpad(F.col("i").cast("string"), 4, "0")).alias("feature_id"), "i")


@query(f"""with {SAMPLES_SQL}, c as (select 'samples' as labels, grp as y, count(*) as n from samples group by all union all select 'vectors', case when cast(embedding[1] as double) + cast(embedding[2] as double) - cast(embedding[3] as double) > 0 then '1' else '0' end, count(*) from embeddings group by all),
t as (select labels, count(*) as classes, min(n) as smallest_n, cast(sum(n) as bigint) as total from c group by labels),
r as (select *, least(5, greatest(smallest_n, case when analysis = 'forest' then 2 else 0 end)) as k, case when exploratory then small else 6 end as need, case when analysis = 'forest' then 2 else 4 end as few
  from t, (values ('forest', 2), ('sparse', 5)) a(analysis, small), (values (false), (true)) e(exploratory)),
o as (select *, classes >= 2 and smallest_n >= need and k >= few as accepted from r)
select labels, analysis, exploratory, classes, smallest_n, cast(k as integer) as folds, not exploratory and total // k >= 3 as grouped, accepted and not exploratory and smallest_n >= 8 as holds_out, accepted from o""")
def selection_policy(s, d):
    """What is decided of the samples and of the embeddings before a fit."""
    every = None
    for name, labels in (("samples", bridge.samples(s, d).select(F.col("grp").alias("y"))), ("vectors", vectors_of(s, d).select("y"))):
        for analysis in ("forest", "sparse"):
            for exploratory in (False, True):
                row = policy.decision(labels, analysis, exploratory=exploratory).select(F.lit(name).alias("labels"), "analysis", F.lit(exploratory).alias("exploratory"), "classes", "smallest_n", "folds", "grouped", "holds_out", "accepted")
                every = row if every is None else every.unionByName(row)
    return every


def _shown(pred, classes):
    p = [F.round(F.col("probabilities")[i], 6).alias(f"p_{c.lower().replace(' ', '_')}") for i, c in enumerate(classes)]
    return pred.select("id", "part", "fold", "actual", "predicted", *p)


def _or_none(s, make, schema):
    """What a policy refuses has no rows."""
    try:
        return make()
    except policy.PolicyError:
        return s.createDataFrame([], schema)


_PREDICTED = "id {0}, part string, fold int, actual string, predicted string, probabilities array<double>"


@query()
def forest_predictions(s, d):
    """Out-of-fold predictions of the samples' groups. Five samples a group: exploratory."""
    p, own = half_prepared(s, d)
    return _shown(_or_none(s, lambda: fitted.matrix_predictions(p, own, exploratory=True), _PREDICTED.format("string")), GROUPS)


@query()
def forest_importance(s, d):
    """Features by their importance in a forest of all samples."""
    p, own = half_prepared(s, d)
    table = _or_none(s, lambda: fitted.matrix_importance(p, own, exploratory=True), "feature_id string, importance double")
    return sl.by_importance(table, "importance", 50).select("rank", "feature_id", F.round("importance", 9).alias("importance"))


@query()
def sparse_coefficients(s, d):
    return fitted.sparse_coefficients(vectors_of(s, d), vector_places(s, d), rule="min").select("feature_id", "class", F.round("coefficient", 6).alias("coefficient"))


@query()
def sparse_scores(s, d):
    """Features by the sizes of their coefficients."""
    c = fitted.sparse_coefficients(vectors_of(s, d), vector_places(s, d), rule="min")
    return sl.by_importance(sl.coefficient_sums(c), "total").select("rank", "feature_id", F.round("total", 6).alias("total"), "classes")


@query()
def sparse_predictions(s, d):
    """Nested cross-validation and a test part."""
    return _shown(fitted.sparse_predictions(vectors_of(s, d)), ["0", "1"])


_EVAL = """with e as (select vec_id, cast(label % 2 as varchar) as actual, round(abs(cast(embedding[2] as double)) - floor(abs(cast(embedding[2] as double))), 3) as p from embeddings),
pr as (select *, case when p > 0.5 then '1' else '0' end as predicted from e),
c as (select distinct actual as class from pr union select distinct predicted from pr),
m as (select class, count(*) filter (where actual = class and predicted = class) as tp, count(*) filter (where actual <> class and predicted = class) as fp, count(*) filter (where actual <> class and predicted <> class) as tn, count(*) filter (where actual = class and predicted <> class) as fn from c cross join pr group by class),
r as (select round(tp / nullif(tp + fn, 0), 6) as sensitivity, round(tn / nullif(tn + fp, 0), 6) as specificity, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) as f1 from m),
b as (select p, count(*) filter (where actual = '1') as y, count(*) filter (where actual <> '1') as q from pr group by p),
a as (select *, coalesce(sum(q) over (order by p rows between unbounded preceding and 1 preceding), 0) as below from b)
"""


@query(_EVAL + """select 'Accuracy' as "Metric", round(avg(case when actual = predicted then 1.0 else 0 end), 6) as "Value" from pr union all select 'Macro sensitivity', round(avg(sensitivity), 6) from r union all select 'Macro specificity', round(avg(specificity), 6) from r
union all select 'Macro F1', round(avg(f1), 6) from r union all select 'AUC', round(sum((below + q / 2.0) * y) / cast(sum(y) * sum(q) as double), 6) from a""")
def prediction_evaluation(s, d):
    """The summary of predictions, as the fitted models' is made, of a rule's probabilities that both engines can state."""
    e = bridge.table(s, d, "embeddings")
    x = F.abs(F.col("embedding")[1].cast("double"))
    p = F.round(x - F.floor(x), 3)
    pred = e.select(F.col("vec_id").alias("id"), (F.col("label") % 2).cast("string").alias("actual"), F.array(F.round(1 - p, 3), p).alias("probabilities"))
    return fitted.evaluation(pred.withColumn("predicted", rs.likeliest(F.col("probabilities"), ["0", "1"])), ["0", "1"])["summary_metrics"]


@query(prepared_sql(0.5).replace("with samples", "with recursive samples", 1) + """, o as (select * from samples where sample_ord < 8), n as (select count(*) as n, (count(*) ** 3 - count(*)) / 3 as most from o),
c as (select feature_id, round(x, 9) as x, sample_ord as t from p join o using (sample)),
kk as (select feature_id, rank() over (partition by feature_id order by x) as rx, rank() over (partition by feature_id order by t) as rt, count(*) over (partition by feature_id, x) as same from c),
f as (select feature_id, cast(sum((rx - rt) ** 2) as bigint) as dd, round(corr(rx, rt), 6) as rho from kk group by feature_id having max(same) = 1 and count(*) > 2),
w(i, mask, dd) as (select 0, 0, 0 union all select i + 1, mask | (1 << j), dd + (i - j) * (i - j) from w, generate_series(0, 7) g(j), n where i < n.n and j < n.n and (mask & (1 << j)) = 0),
z as (select dd, count(*) as ways from w, n where i = n.n group by dd),
u as (select dd, sum(ways) over (order by dd desc) / sum(ways) over () as up, sum(ways) over (order by dd) / sum(ways) over () as down from z)
select f.feature_id, f.rho, round(least(1, 2 * case when f.dd > most / 2 then up else down end), 9) as p from f join u using (dd), n""")
def order_spearman_exact(s, d):
    """Features along the first eight samples, where no two values are equal: exact p."""
    order = bridge.samples(s, d).filter("sample_ord < 8").select("sample", F.col("sample_ord").cast("double").alias("t"))
    return rd.profile_correlation(*half_prepared(s, d), order).filter("not ties").select("feature_id", F.round("rho", 6).alias("rho"), F.round("p", 9).alias("p"))


_HEAT = prepared_sql(0.5) + ", v as (select feature_id, round(var_samp(x), 9) as variance from p group by feature_id), b as (select feature_id, row_number() over (order by feature_id) as row_order from (select * from v order by variance desc, feature_id limit 100))"


def _heatmap(s, d, **how):
    p, own = half_prepared(s, d)
    return rd.heatmap(p, own, **how)


@query(_HEAT + " select cast(row_order as integer) as row_order, p.feature_id, p.sample, round(coalesce((x - avg(x) over f) / nullif(stddev_samp(x) over f, 0), 0), 6) as z from p join b using (feature_id) window f as (partition by p.feature_id)")
def heatmap_values(s, d):
    return _heatmap(s, d)[0].withColumn("z", F.round("z", 6))


@query(_HEAT + " select cast(row_order as integer) as row_order, feature_id from b")
def heatmap_row_order(s, d):
    return _heatmap(s, d)[1].drop("kmeans_cluster")


@query(f"with {SAMPLES_SQL} select cast(row_number() over (order by sample_ord, sample) as integer) as col_order, sample, grp from samples")
def heatmap_col_order(s, d):
    return _heatmap(s, d)[2].drop("kmeans_cluster")


@query()
def heatmap_kmeans_rows(s, d):
    """Features of the heatmap in the order of their clusters."""
    return _heatmap(s, d, rows="kmeans")[1]


@query()
def heatmap_kmeans_columns(s, d):
    """Samples of the heatmap in the order of their clusters."""
    return _heatmap(s, d, columns="kmeans")[2]


def rule_lists(s, d):
    """Three ranked lists, of 30 features each."""
    f = rule_fits(s, d).filter("gini_rank <= 30")
    return [(name, f.filter(F.col("repeat") == i).select("feature_id", F.col("gini_rank").alias("rank"))) for i, name in ((1, "rf"), (2, "l1"), (3, "rfl1"))]


@query(prepared_sql(0.5) + ", " + _FITS[len("with ") : _FITS.index(", r as (")] + """, m as (select *, row_number() over (partition by feature_id order by repeat) as n from f where repeat <= 3 and gini_rank <= 30),
u as (select feature_id, repeat, row_number() over (order by repeat, gini_rank, feature_id) as place from m where n = 1)
select p.feature_id, p.sample, ['rf', 'l1', 'rfl1'][repeat] as source, cast(place as integer) as place, round(x, 6) as x, round(coalesce((x - avg(x) over w) / nullif(stddev_samp(x) over w, 0), 0), 6) as z from p join u on u.feature_id = p.feature_id and place <= 50 window w as (partition by p.feature_id)""")
def selected_feature_matrix(s, d):
    """Values and scores of the features that ranked lists select, in the lists' order."""
    z = sl.selected_scores(prepared(s, d, 0.5), rule_lists(s, d))
    return z.select("feature_id", "sample", "source", "place", F.round("x", 6).alias("x"), F.round("z", 6).alias("z"))


@query(_FITS[: _FITS.index(", r as (")] + """, b as (select * from f where gini_rank <= 60) select a.feature_id, round(1.0 / r.gini_rank, 6) as importance, round(1.0 / l.gini_rank, 6) as coefficient, case when r.repeat is not null and l.repeat is not null then 'RF+L1' when r.repeat is not null then 'RF' when l.repeat is not null then 'L1' end as source
from b a left join b r on r.feature_id = a.feature_id and r.repeat = 2 left join b l on l.feature_id = a.feature_id and l.repeat = 3 where a.repeat = 1""")
def combined_sources(s, d):
    """What selected each feature of a combined list."""
    f = rule_fits(s, d).filter("gini_rank <= 60")
    of = [f.filter(F.col("repeat") == i) for i in (1, 2, 3)]
    out = sl.with_source(of[0].select("feature_id"), of[1].select("feature_id", F.col("gini").alias("importance")), of[2].select("feature_id", F.col("gini").alias("coefficient")))
    return out.select("feature_id", F.round("importance", 6).alias("importance"), F.round("coefficient", 6).alias("coefficient"), "source")


@query(_FITS[: _FITS.index(", r as (")] + " select feature_id, round(sum(1.0 / gini_rank), 6) as total, count(*) as classes from f where gini_rank <= 200 and gini_rank % 3 > 0 group by feature_id")
def coefficient_sums(s, d):
    """Sizes of coefficients over classes, of coefficients that a rule gives."""
    sign = F.when(F.col("gini_rank") % 3 == 0, 0).when(F.col("gini_rank") % 3 == 1, 1).otherwise(-1)
    c = rule_fits(s, d).select("feature_id", F.col("repeat").cast("string").alias("class"), (sign / F.col("gini_rank")).alias("coefficient"))
    return sl.coefficient_sums(c).withColumn("total", F.round("total", 6))


_TIMES = f"with {SAMPLES_SQL}, o as (select sample, grp, 1 + group_ord % 2 as lineage, cast((sample_ord * 7) % 10 as double) as pseudotime from samples)"


def rule_pseudotime(s, d):
    """Pseudotimes that a rule gives."""
    return bridge.samples(s, d).select("sample", "grp", (1 + F.col("group_ord") % 2).alias("lineage"), ((F.col("sample_ord") * 7) % 10).cast("double").alias("pseudotime"))


@query(_TIMES + " select lineage, cast(row_number() over (partition by lineage order by pseudotime, sample) as integer) as place, sample, pseudotime from o")
def samples_in_pseudotime(s, d):
    return rd.in_pseudotime(rule_pseudotime(s, d))


@query(_TIMES + " select s.sample, cast(s.sample_ord as double) as x, lineage, pseudotime from samples s left join (select * from o where lineage = 1) o using (sample)")
def coordinates_with_pseudotime(s, d):
    """Coordinates of all samples with the pseudotimes of one lineage."""
    return rd.with_pseudotime(bridge.samples(s, d).select("sample", F.col("sample_ord").cast("double").alias("x")), rule_pseudotime(s, d).filter("lineage = 1"))


@query(_TIMES + ", m as (select lineage, grp, avg(pseudotime) as t from o group by all) select lineage, string_agg(grp, ' -> ' order by t, grp) as path from m group by lineage")
def lineage_paths(s, d):
    return rd.lineage_paths(rule_pseudotime(s, d))


from quillon.plans import importing  # noqa: E402, F401 - its queries are registered here as well
