"""DuckDB SQL with the same rows as the queries, where SQL can express them.

The others train a model, tokenize, draw hashes of this library or locate matches inside texts; they are tested
against brute force instead.
"""

from __future__ import annotations

from litmill.llm.decontamination import SHARE, WINDOW
from litmill.llm.lines import MIN_WORDS

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_EMPTY = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"

OP1 = rf"""
with d as (select doc_id, text, string_split(text, chr(10)) as ls from documents),
l as (select doc_id, i as p, ls[i] as line, len(regexp_extract_all(ls[i], '[^\x20\x09-\x0D]+')) as w from (select doc_id, ls, unnest(range(1, len(ls) + 1)) as i from d)),
n as (select *, row_number() over (partition by doc_id order by p) as k, sum(w) over (partition by doc_id order by p) as c from l where w > 0),
f as (select a.doc_id, a.k as k0, min(b.k) as k1 from n a join n b on a.doc_id = b.doc_id and b.k >= a.k and b.k < a.k + {MIN_WORDS} and b.c - a.c + a.w >= {MIN_WORDS} group by 1, 2),
r as (select b.doc_id, max(a.k) as k0, b.k as k1 from n b join n a on a.doc_id = b.doc_id and a.k <= b.k and a.k > b.k - {MIN_WORDS} and b.c - a.c + a.w >= {MIN_WORDS} group by 1, 3),
s as (select * from f union select * from r),
g as (select s.doc_id, s.k0, s.k1, string_agg(n.line, chr(10) order by n.k) as body, min(n.p) as p0, max(n.p) as p1 from s join n on n.doc_id = s.doc_id and n.k between s.k0 and s.k1 group by 1, 2, 3),
x as (select * from g qualify row_number() over (partition by body order by doc_id, k0) > 1),
gone as (select distinct l.doc_id, l.p from l join x on l.doc_id = x.doc_id and l.p between x.p0 and x.p1)
select d.doc_id, coalesce(len(ls), 0)::bigint as n_lines, count(gone.p)::bigint as n_removed,
  case when count(gone.p) = 0 then any_value(d.text) else coalesce((select string_agg(l.line, chr(10) order by l.p) from l where l.doc_id = d.doc_id and not exists (select 1 from gone z where z.doc_id = l.doc_id and z.p = l.p)), '') end as text
from d left join gone on gone.doc_id = d.doc_id group by d.doc_id, ls"""

OP6 = r"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations union all select -7, t, r, '\### Assistant: </turn> ok' from (values (0, 'user'), (1, 'assistant')) v(t, r)),
e as (select *, length(role) + length(regexp_replace(role, '[^\\#<:]', '', 'g')) + length(text) + length(regexp_replace(text, '[^\\#<]', '', 'g')) + 14 as n from c)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars, coalesce(sha256(string_agg(text, '' order by turn, role, text) filter (role = 'assistant')), 'EMPTY') as loss_sha256,
  sum(n)::bigint as formatted_chars, false as rewrites_history
from e group by 1""".replace("EMPTY", _EMPTY)

OP7 = rf"""
with recursive w as (select doc_id, regexp_extract_all({_LOW}, '[^\x20\x09-\x0D]+') as ws from documents),
s as (select distinct doc_id, sh from (select doc_id, case when len(ws) < 3 then array_to_string(ws, ' ') else array_to_string(ws[i:i + 2], ' ') end as sh from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 2))) as i from w where len(ws) > 0))),
n as (select doc_id, count(*) as n from s group by 1),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.sh = b.sh and a.doc_id <> b.doc_id group by 1, 2),
e as (select p.a, p.b from p join n x on x.doc_id = p.a join n y on y.doc_id = p.b where 100 * c >= 85 * (x.n + y.n - c)),
reach as (select doc_id as a, doc_id as b from documents union select r.a, e.b from reach r join e on e.a = r.b)
select r.a as doc_id, coalesce(any_value(n.n), 0)::bigint as n_shingles, min(r.b) as component_id, r.a = min(r.b) as kept from reach r left join n on n.doc_id = r.a group by r.a"""

OP8 = rf"""
with dw as (select doc_id, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
bw as (select row_number() over () as row, coalesce(item_id::varchar, 'null') as item, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from benchmark),
win as (select distinct row, item, i, least(len(ws), {WINDOW}) as m, array_to_string(ws[i:i + {WINDOW - 1}], ' ') as g from (select row, item, ws, unnest(range(1, greatest(len(ws) - {WINDOW - 2}, 2))) as i from bw where len(ws) > 0)),
sizes as (select distinct m from win),
occ as (select doc_id, i, m, array_to_string(ws[i:i + m - 1], ' ') as g from (select doc_id, ws, m, unnest(range(1, len(ws) - m + 2)) as i from dw, sizes where len(ws) >= m)),
hits as (select o.doc_id, o.i, o.m, w.row, w.item, w.i as k from occ o join win w on w.m = o.m and w.g = o.g),
cov as (select doc_id, count(distinct q) as n_hit from (select doc_id, unnest(range(i, i + m)) as q from hits) group by 1),
run as (select doc_id, max(m) + count(*) - 1 as n from (select *, i - row_number() over (partition by doc_id, row, i - k order by i) as g from hits) group by doc_id, row, i - k, g),
lng as (select doc_id, max(n) as n from run group by 1),
its as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item from hits) group by 1)
select dw.doc_id, len(ws)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and {SHARE} * coalesce(n_hit, 0) >= len(ws) as contaminated, coalesce(lng.n, 0)::int as longest_match
from dw left join cov using (doc_id) left join its using (doc_id) left join lng using (doc_id)"""


def oracle_sql() -> dict[str, str]:
    return {"op1_lines": OP1, "op6_chat": OP6, "op7_minhash": OP7, "op8_decontamination": OP8}
