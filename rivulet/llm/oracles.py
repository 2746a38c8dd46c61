"""DuckDB SQL for the queries that SQL can express, written from the definitions and not from the operators' plans."""

from __future__ import annotations

_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_NORMAL = r"regexp_extract_all(" + _FOLD + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SUBSTRING = r"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
p as (select r, w, unnest(range(1, len(w) - 33)) as i from d where len(w) >= 35),
h as (select r, i, md5(array_to_string(w[i:i + 34], ' ')) as h from p),
dup as (select h from h group by h having count(*) > 1),
gone as (select distinct r, unnest(range(i, i + 35)) as k from h semi join dup using (h)),
each as (select r, unnest(w) as word, unnest(range(1, len(w) + 1)) as k from d),
left_over as (select r, string_agg(word, ' ' order by k) as kept, count(*) as n from each anti join gone using (r, k) group by r)
select doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from d left join left_over using (r)
"""

LINES = rf"""
with l as (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(1, len(string_split(text, chr(10))) + 1)) as i from documents where text is not null),
w as (select doc_id, i, {_NORMAL.format("line")} as w from l),
t as (select distinct doc_id, i, unnest(case when len(w) < 5 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' ')) end) as t from w where len(w) > 0),
m as (select doc_id, i, count(*) as m from t group by all),
c as (select a.doc_id, a.i, b.doc_id as e, b.i as j, count(*) as c from t a join t b using (t) where (b.doc_id, b.i) < (a.doc_id, a.i) group by all),
gone as (select distinct c.doc_id, c.i from c join m x on x.doc_id = c.doc_id and x.i = c.i join m y on y.doc_id = c.e and y.i = c.j where c >= 0.8e0 * (x.m + y.m - c) - 1e-12),
k as (select doc_id, string_agg(line, chr(10) order by i) as kept, count(*) as n from l anti join gone using (doc_id, i) group by 1),
n as (select doc_id, count(*) as n_lines from l group by 1)
select d.doc_id, coalesce(n_lines, 0) as n_lines, coalesce(n_lines, 0) - coalesce(k.n, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from documents d left join n using (doc_id) left join k using (doc_id)
"""

NEAR = rf"""
with recursive w as (select doc_id, text, {_NORMAL.format("coalesce(text, '')")} as w from documents),
s as (select doc_id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] when text <> '' then ['raw ' || text] else [] end) as s from w),
t as (select doc_id, s, row_number() over (partition by doc_id, s) as o from s),
m as (select doc_id, count(*) as m from t group by 1),
c as (select a.doc_id as u, b.doc_id as v, count(*) as c from t a join t b using (s, o) where a.doc_id < b.doc_id group by all),
e as (select u, v from c join m x on x.doc_id = u join m y on y.doc_id = v where c >= 0.8e0 * (x.m + y.m - c) - 1e-12),
arcs as (select u, v from e union all select v, u from e),
reach(u, v) as (select doc_id, doc_id from documents union select r.u, b.v from reach r join arcs b on b.u = r.v)
select u as doc_id, min(v) as class_id, u = min(v) as kept from reach group by u
"""

EMBEDDINGS = """
with recursive v as (select vec_id, embedding::double[] as x from embeddings where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda e: e is null or not isfinite(e))) = 0 and len(list_filter(embedding, lambda e: e <> 0)) > 0),
e as (select a.vec_id as u, b.vec_id as v from v a join v b on a.vec_id <> b.vec_id and len(a.x) = len(b.x) and list_cosine_similarity(a.x, b.x) >= 0.9e0),
reach(u, v) as (select vec_id, vec_id from embeddings union select r.u, e.v from reach r join e on e.u = r.v),
n as (select u, count(*) as n from e group by 1)
select reach.u as vec_id, coalesce(n, 0)::bigint as n_links, min(reach.v) as component_id, reach.u = min(reach.v) as kept from reach left join n using (u) group by reach.u, n
"""

DECONTAMINATION = rf"""
with i as (select item_id::varchar as item, {_NORMAL.format("coalesce(text, '')")} as w from benchmark),
g as (select distinct item, least(len(w), 10) as n, unnest(list_transform(range(1, greatest(len(w) - 10, 0) + 2), lambda k: array_to_string(w[k:k + least(len(w), 10) - 1], ' '))) as g from i where len(w) > 0),
d as (select row_number() over () as r, doc_id, {_NORMAL.format("coalesce(text, '')")} as w from documents),
p as (select r, n, w, unnest(range(1, len(w) - n + 2)) as k from d cross join (select distinct n from g) where len(w) >= n),
h as (select r, p.n, k, item from p join g on g.n = p.n and g.g = array_to_string(w[k:k + p.n - 1], ' ')),
hit as (select r, count(distinct x) as n_hit from (select r, unnest(range(k, k + n)) as x from h) group by r),
items as (select r, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct r, item from h where item is not null) group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hit using (r) left join items using (r)
"""

AUDIT = r"""
with d as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
m as (select t, min(doc_id) as least from d group by t),
x as (select part, doc_id, [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w), 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > least, least is not null)] as f from d join m using (t)),
l as (select doc_id, coalesce(max((quality = 1)::int), 0) as good, coalesce(max((toxic = 1)::int), 0) as toxic from labels where doc_id is not null group by 1),
c as (select part, f, count(*) as n, sum(coalesce(good, 0)) as good, sum(coalesce(toxic, 0)) as toxic from x left join l using (doc_id) group by all),
o as (select a || b || c || d || e as filter_order from unnest(['A','B','C','D','E']) t1(a), unnest(['A','B','C','D','E']) t2(b), unnest(['A','B','C','D','E']) t3(c), unnest(['A','B','C','D','E']) t4(d), unnest(['A','B','C','D','E']) t5(e) where len(list_distinct([a, b, c, d, e])) = 5),
s as (select filter_order, step, ascii(filter_order[step]) - 64 as k, list_transform(range(1, step), lambda i: ascii(filter_order[i]) - 64) as before from o, unnest(range(1, 6)) u(step)),
e as (select part, filter_order, step, k, f, n, good, toxic, f[k] as fails, len(list_filter(before, lambda i: f[i])) = 0 as reached, len(list_filter(f, lambda b: b)) as failed from s cross join c),
g as (select part, filter_order, step, k, sum(n) filter (reached and not fails) as kept, sum(n) filter (reached and fails) as removed, sum(n) filter (fails and not reached) as redundant, sum(n) filter (fails and failed = 1) as unique_fails, sum(good) filter (reached and fails) as good_lost, sum(toxic) filter (reached and fails) as toxic_lost from e group by all)
select part, filter_order, step::int as step, coalesce(kept, 0)::bigint as kept, coalesce(removed, 0)::bigint as removed, coalesce(redundant, 0)::bigint as redundant, coalesce(unique_fails, 0)::bigint as unique_fails, coalesce(good_lost, 0)::bigint as good_lost, coalesce(toxic_lost, 0)::bigint as toxic_lost,
  sum(coalesce(removed, 0)) over (partition by part, k)::bigint as shapley from g
"""

SUFFIXES = """
with d as (select row_number() over () as r, doc_id, encode(coalesce(text, '')) as t from documents),
w as (select r, i, md5(array_slice(t, i, i + 199)) as h from (select r, t, unnest(range(1, octet_length(t) - 198)) as i from d where octet_length(t) >= 200)),
s as (select r, i from w semi join (select h from w group by h having count(*) > 1) using (h)),
g as (select r, i, (i > 200 + lag(i, 1, -1000) over (partition by r order by i))::int as new from s),
runs as (select r, g, min(i) as a, max(i) + 200 as b from (select r, i, sum(new) over (partition by r order by i) as g from g) group by r, g),
cuts as (select r, list(a order by a) as a, list(b order by a) as b, sum(b - a) as n_removed, count(*) as n_spans from runs group by r),
k as (select r, string_agg(hex(array_slice(t, x, y)), '' order by x) as kept from (select r, t, unnest(list_prepend(1, b)) as x, unnest(list_append(a, octet_length(t) + 1)) - 1 as y from d join cuts using (r)) where y >= x group by r)
select doc_id, octet_length(t)::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans, case when n_spans is null then sha256(t) else sha256(unhex(coalesce(kept, ''))) end as kept_sha256
from d left join cuts using (r) left join k using (r)
"""
