"""DuckDB SQL for the queries that it can state."""

from __future__ import annotations

from quillon.llm import mixing

WORD = r"[^\x20\x09-\x0D]+"

JACCARD = rf"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') as w from documents),
s as (select distinct doc_id, g from (select doc_id, unnest(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) end) as g from w)),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
l as (select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where 100 * c >= 90 * (a.n + b.n - c)),
e as (select x, y from l union all select y, x from l),
reach(doc_id, low) as (select doc_id, doc_id from documents union select e.y, r.low from reach r join e on e.x = r.doc_id where r.low < e.y)
select d.doc_id, coalesce(n.n, 0) as n_shingles, m.low as component_id
from documents d left join n using (doc_id) join (select doc_id, min(low) as low from reach group by doc_id) m using (doc_id)"""

SUBSTRING = rf"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') as w from documents),
s as (select doc_id, unnest(range(1, len(w) - 18)) as i, unnest(list_transform(range(1, len(w) - 18), lambda i: array_to_string(w[i:i + 19], ' '))) as g from w where len(w) >= 20),
r as (select doc_id, i, row_number() over (partition by g order by doc_id, i) as k from s),
gone as (select distinct doc_id, unnest(range(i, i + 20)) as i from r where k > 1),
every as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as i from w),
kept as (select e.doc_id, count(*) filter (where g.i is not null) as n_removed, coalesce(string_agg(word, ' ' order by e.i) filter (where g.i is null), '') as t
  from every e left join gone g on g.doc_id = e.doc_id and g.i = e.i group by e.doc_id)
select w.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(t, '')) as kept_sha256 from w left join kept using (doc_id)"""

EXACT = """
with d as (select doc_id, coalesce(text, '') as t from documents),
k as (select *, max(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size, row_number() over (partition by t order by doc_id desc nulls last) as place from d)
select doc_id, keep_id, group_size, place = 1 as kept, sha256(t) as text_sha256 from k"""

COLLOCATIONS = r"""
with d as (select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
p as (select lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) as p from d),
w as (select lang, regexp_extract_all(p, '[^\x20\x09]+') as w from p),
g as (select lang, unnest(list_transform(range(1, len(w) - k + 2), lambda i: w[i:i + k - 1])) as g from w, (values (1), (2), (3)) s(k) where len(w) >= k),
f as (select lang, g, count(*) as f from g group by all),
n as (select lang, cast(sum(f) as bigint) as n from f where len(g) = 1 group by lang),
c as (select lang, g, f as a from f where len(g) > 1 and f >= 10),
k as (select *, unnest(range(1, len(g))) as k from c),
s as (select k.*, x.f as l, y.f as r, cast(1000000::hugeint * a * a // (x.f::hugeint * y.f) as bigint) as score from k join f x on x.lang = k.lang and x.g = k.g[1:k] join f y on y.lang = k.lang and y.g = k.g[k + 1:]),
b as (select *, row_number() over (partition by lang, g order by score, k) as place from s),
j as (select lang, part, max(a) as longest from (select lang, a, unnest([g[1:2], g[2:3]]) as part from c where len(g) = 3) group by all),
o as (select b.lang, array_to_string(b.g, ' ') as phrase, a, l, r, score from b left join j on j.lang = b.lang and j.part = b.g where place = 1 and not coalesce(100 * longest >= 50 * a, false)),
q as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from o)
select lang, rank, phrase, a, l, r, n, score from q join n using (lang) where rank <= 2000"""

SQL = {"op4_jaccard_metric_join": JACCARD, "op5_hierarchical_mixing": mixing.oracle(), "op8_super_kmer_dedup": SUBSTRING, "op11_exact_dedup": EXACT, "op13_collocations": COLLOCATIONS}
