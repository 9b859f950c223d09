"""What SQL can express of the numbered queries, for DuckDB."""

from __future__ import annotations

OP1 = r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e as (
  select *, replace(replace(replace(replace(replace(role, '\', '\s'), '<turn:', '\lturn:'), '</turn>', '\l/turn>'), '<and/>', '\land/>'), '>', '\g') as erole,
    replace(replace(replace(replace(text, '\', '\s'), '<turn:', '\lturn:'), '</turn>', '\l/turn>'), '<and/>', '\land/>') as etext from t),
b as (select *, coalesce(lag(erole) over w <> erole, true) as fresh from e window w as (partition by conv_id order by turn, erole, etext))
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, erole, etext)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, erole, etext) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(length(etext) + case when fresh then length('<turn:></turn>') + length(erole) else length('<and/>') end) as bigint) as formatted_chars
from b group by conv_id
"""

OP2 = r"""
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as l from documents),
s as (
  select doc_id, unnest(list_distinct(case when len(l) = 0 then [] when len(l) < 5 then [array_to_string(l, ' ')]
    else list_transform(range(1, len(l) - 3), lambda i: array_to_string(l[i:i + 4], ' ')) end)) as x from w),
n as (select w.doc_id, count(x) as n from w left join s using (doc_id) group by 1),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.x = b.x and a.doc_id < b.doc_id group by 1, 2),
e as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
g as (select a, b from e union all select b, a from e),
r as (select doc_id, doc_id as c from documents union select g.b, r.c from r join g on g.a = r.doc_id)
select n.doc_id, n.n as n_shingles, m.c as component_id, n.doc_id = m.c as kept
from n join (select doc_id, min(c) as c from r group by 1) m using (doc_id)
"""

OP7 = r"""
with recursive v as (
  select vec_id, label, cast(embedding as double[]) as x from embeddings
  where label is not null and len(list_filter(embedding, lambda y: y is null or not isfinite(y))) = 0 and len(list_filter(embedding, lambda y: y <> 0)) > 0),
e as (
  select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id
  where list_cosine_similarity(a.x, b.x) >= 0.98),
r as (select vec_id, vec_id as c from embeddings union select e.b, r.c from r join e on e.a = r.vec_id)
select t.vec_id, coalesce(k.n, 0) as n_links, m.c as component_id, t.vec_id = m.c as kept
from embeddings t left join (select a, count(*) as n from e group by 1) k on k.a = t.vec_id
join (select vec_id, min(c) as c from r group by 1) m on m.vec_id = t.vec_id
"""

OP9 = r"""
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = max(doc_id) over w as kept, sha256(coalesce(text, '')) as text_sha256
from documents window w as (partition by coalesce(text, ''))
"""

OP11 = r"""
with w as (
  select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as l,
    min(doc_id) over (partition by coalesce(text, '')) as first from documents),
m as (select doc_id, max(quality) = 1 as good, max(toxic) = 1 as toxic from labels group by 1),
d as (
  select part, coalesce(good, false) as good, coalesce(toxic, false) as toxic,
    [len(l) < 100, 100 * len(list_distinct(l)) < 80 * len(l), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t),
      regexp_matches(t, '[#$%&*|]'), doc_id > first] as f
  from w left join m using (doc_id)),
k as (select part, [x for x in ['A', 'B', 'C', 'D', 'E'] if f[ord(x) - 64]] as bad, good, toxic from d),
x as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
o as (select [a.x, b.x, c.x, e.x, g.x] as o from x a, x b, x c, x e, x g where len(list_distinct([a.x, b.x, c.x, e.x, g.x])) = 5),
s as (select unnest(range(1, 6)) as step),
r as (
  select part, o, step, o[step] as letter, count(*) filter (len(list_intersect(bad, o[1:step])) = 0) as kept,
    count(*) filter (list_contains(bad, o[step]) and len(list_intersect(bad, o[1:step - 1])) = 0) as removed,
    count(*) filter (list_contains(bad, o[step]) and len(list_intersect(bad, o[1:step - 1])) > 0) as redundant,
    count(*) filter (bad = [o[step]]) as unique_fails,
    count(*) filter (good and list_contains(bad, o[step]) and len(list_intersect(bad, o[1:step - 1])) = 0) as good_lost,
    count(*) filter (toxic and list_contains(bad, o[step]) and len(list_intersect(bad, o[1:step - 1])) = 0) as toxic_lost
  from k, o, s group by all)
select part, array_to_string(o, '') as filter_order, cast(step as int) as step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  cast(sum(removed) over (partition by part, letter) as bigint) as shapley
from r
"""

#: CRC-32 by its rule; near words by the words that one deletion leaves.
OP13 = r"""
with recursive c as (
  select list(v order by i) as t from (
    select i, list_reduce(list_prepend(i, range(8)), lambda a, k: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end) as v from range(256) x(i))),
u as (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')) as u from documents),
l as (select doc_id, translate(u, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as r, count(*) as n from u where length(u) >= 5 group by all),
y as (select r, n, string_split(regexp_replace(hex(encode(doc_id || ':' || r)), '(..)', '\1 ', 'g'), ' ')[1:-2] as y from l),
h as (select r, n, 4294967295 - list_reduce(list_prepend(4294967295, list_transform(y, lambda b: cast('0x' || b as bigint))), lambda a, b: xor(a >> 8, c.t[1 + (xor(a, b) & 255)])) as h from y, c),
w as (
  select case when h % 97 = 0 then substr(r, 1, cast(h % length(r) as int)) || substr(r, cast(h % length(r) as int) + 2) else r end as word, cast(sum(n) as bigint) as n
  from h group by 1 having sum(n) >= 3),
v as (select word, n from w where length(word) >= 5),
d as (select word, i, substr(word, 1, i - 1) || substr(word, i + 1) as x from (select word, unnest(range(1, length(word) + 1)) as i from v)),
k as (
  select distinct a.word as a, b.word as b from d a join d b on a.i = b.i and a.x = b.x and a.word <> b.word
  union select d.word, v.word from d join v on v.word = d.x union select v.word, d.word from d join v on v.word = d.x),
f as (select a, count(*) as n_near, first(b order by v.n desc, b) as b, max(v.n) as n from k join v on v.word = k.b group by a),
t as (select v.word, v.n, coalesce(f.n_near, 0) as n_near, case when f.n >= 2 * v.n then f.b end as form, case when f.n >= 2 * v.n then f.n end as form_n from v left join f on f.a = v.word),
r as (select word, word as at from t union all select r.word, t.form from r join t on t.word = r.at where t.form is not null),
z as (select r.word, r.at as root from r join t on t.word = r.at where t.form is null)
select t.word, t.form, z.root, t.n, t.n_near, t.form_n from t join z using (word)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_format": OP1, "op2_minhash_dedup": OP2, "op7_embedding_dedup": OP7, "op9_exact_dedup": OP9, "op11_filter_audit": OP11, "op13_spelling_variants": OP13}
