"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .mixing import ROUNDS


def _mix_round(n: int) -> str:
    """The n-th threshold: places in order, as long as their running sum stays within the need."""
    return f"""
e{n} as (select d.source, d.place, sum(d.size) as words from sized d join s{n} s on d.source is not distinct from s.source
  where d.place >= s.start and d.size <= s.need group by all),
c{n} as (select source, place, sum(words) over (partition by source order by place) as through from e{n}),
t{n} as (select s.source, coalesce(min(c.place) filter (c.through > s.need), 16777216) as threshold,
  coalesce(max(c.through) filter (c.through <= s.need), 0) as got from s{n} s left join c{n} c on s.source is not distinct from c.source group by s.source),
s{n + 1} as (select s.source, s.need - t.got as need, t.threshold as start from s{n} s join t{n} t on s.source is not distinct from t.source),"""


MIXING = (
    r"""
with sized as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
  ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 6))::bigint as place from documents),
p as (select source, sum(size)::bigint as source_size from sized group by source),
w as (select *, [1, 2, 3][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int]::bigint as weight from p),
l as (select *, (sum(source_size) over () - coalesce(sum(3 * source_size) over b, 0))::double / (sum(weight) over () - coalesce(sum(weight) over b, 0))::double as level,
  row_number() over (order by source_size / weight, source nulls last) as nth
  from w window b as (order by source_size / weight, source nulls last rows between unbounded preceding and 1 preceding)),
f as (select arg_min(level, nth) as level from l where level * weight <= 3 * source_size),
g as (select source, source_size, weight, coalesce(least((3 * source_size)::double, (select level from f) * weight), (3 * source_size)::double) as target from l),
h as (select *, case when source_size > 0 then floor(target / source_size) else 0 end::bigint as whole from g),
s0 as (select source, floor(target - whole * source_size)::bigint as need, 0 as start from h),"""
    + "".join(map(_mix_round, range(ROUNDS)))
    + """
x as (select d.*, h.source_size, h.target, h.whole, """
    + " or ".join(f"(d.place >= s{n}.start and d.place < t{n}.threshold and d.size <= s{n}.need)" for n in range(ROUNDS))
    + " as more from sized d join h on d.source is not distinct from h.source "
    + " ".join(f"join s{n} on d.source is not distinct from s{n}.source join t{n} on d.source is not distinct from t{n}.source" for n in range(ROUNDS))
    + """)
select doc_id, size, source_size, target, (size * (whole + case when more then 1 else 0 end))::bigint as taken from x
"""
)

DECONTAMINATION = r"""
with tok as (select 'd' as kind, doc_id as id, [x for x in regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+') if x <> ''] as w from documents
  union all select 'i', item_id, [x for x in regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+') if x <> ''] from benchmark),
cut as (select kind, id, unnest(list_distinct([array_to_string(w[i:i + 4], ' ') for i in range(1, greatest(len(w) - 4, 1) + 1)])) as shingle from tok where len(w) > 0),
item as (select id as item_id, shingle, count(*) over (partition by id) as n_item from cut where kind = 'i'),
hit as (select c.id as doc_id, i.item_id, i.n_item, count(*) as n_shared from cut c join item i using (shingle) where c.kind = 'd' group by all)
select doc_id, item_id, n_item, n_shared, round(n_shared::double / n_item, 6) as containment from hit where n_shared >= n_item * 0.8 - 1e-9
"""

CHAT = r"""
with rows as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
shown as (select *, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '#', '&#35;') as safe, replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '#', '&#35;'), chr(10), '&#10;') as safe_role from rows)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(length('<turn>### ') + length(safe_role) + 1 + length(safe) + length('</turn>') + 1)::bigint as formatted_chars
from shown group by conv_id
"""

EXACT_DEDUP = """
with d as (select *, coalesce(text, '') as t, row_number() over (partition by coalesce(text, '') order by doc_id desc nulls last) as nth from documents)
select doc_id, max(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size, nth = 1 as kept, sha256(t) as text_sha256 from d
"""

COLLOCATIONS = r"""
with w as materialized (select lang, id, piece, unnest(ws) as word, generate_subscripts(ws, 1) as place from (
  select coalesce(lang, 'und') as lang, id, unnest(range(len(ps))) as piece, unnest(list_transform(ps, lambda p: regexp_extract_all(p, '[^\x20\x09]+'))) as ws from (
    select lang, row_number() over () as id, regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') as ps from documents))),
c1 as materialized (select lang, word, count(*) as f from w group by all),
n as (select lang, sum(f)::bigint as n from c1 group by lang),
o as materialized (select lang, word as x, lead(word, 1) over p as y, lead(word, 2) over p as z from w window p as (partition by id, piece order by place)),
c2 as materialized (select lang, x, y, count(*) as f from o where y is not null group by all having f >= 10),
c3 as materialized (select lang, x, y, z, count(*) as f from o where z is not null group by all having f >= 10),
k3 as (select c3.lang, c3.x, c3.y, c3.z, c3.f as a, unnest([{'k': 1, 'l': u.f, 'r': q.f}, {'k': 2, 'l': p.f, 'r': v.f}], recursive := true) from c3
  join c1 u on u.lang = c3.lang and u.word = c3.x join c1 v on v.lang = c3.lang and v.word = c3.z
  join c2 p on p.lang = c3.lang and p.x = c3.x and p.y = c3.y join c2 q on q.lang = c3.lang and q.x = c3.y and q.y = c3.z),
s3 as (select lang, x || ' ' || y || ' ' || z as phrase, a, l, r, (1000000::hugeint * a * a // (l::hugeint * r))::bigint as score from k3
  qualify row_number() over (partition by lang, x, y, z order by 1000000::hugeint * a * a // (l::hugeint * r), k) = 1),
s2 as (select c2.lang, c2.x || ' ' || c2.y as phrase, c2.f as a, u.f as l, v.f as r, (1000000::hugeint * c2.f * c2.f // (u.f::hugeint * v.f))::bigint as score from c2
  join c1 u on u.lang = c2.lang and u.word = c2.x join c1 v on v.lang = c2.lang and v.word = c2.y
  where not exists (select 1 from c3 where c3.lang = c2.lang and 100 * c3.f >= 50 * c2.f and (c3.x = c2.x and c3.y = c2.y or c3.y = c2.x and c3.z = c2.y)))
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score from (from s2 union all from s3) join n using (lang) qualify rank <= 2000
"""

#: Rows whose vector and components are there and finite, as whole numbers.
WHOLE = "select vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::double)::bigint) as v from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0"

TOP_K = f"""
with e as materialized ({WHOLE.format(scale=256)}),
s as (select q.vec_id as query_id, c.vec_id, list_dot_product(q.v::double[], c.v::double[])::bigint as score from e q join e c on c.vec_id is distinct from q.vec_id where q.vec_id % 50 = 0)
select query_id, row_number() over (partition by query_id order by score desc, vec_id nulls last)::int as rank, vec_id, score from s qualify rank <= 5
"""


def _code_round(n: int) -> str:
    """Parts at their nearest entries, and the entries after the n-th round."""
    return f"""
a{n} as materialized (select vec_id, p, any_value(p.x) as x, min({{'d': list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint, 'e': b.e}}) as m from parts p join b{n} b using (p) group by vec_id, p),
u{n} as (select p, m.e as e, i, floor(sum(x[i])::double / count(*))::bigint as y from a{n}, range(1, 17) t(i) group by all),
b{n + 1} as materialized (select b.p, b.e, coalesce(any_value(b.x) filter (u.y is null), list(u.y order by u.i)) as x from b{n} b left join u{n} u on b.p = u.p and b.e = u.e group by all),"""


CODES = (
    f"""
with kept as materialized ({WHOLE.format(scale=1024)}),
parts as materialized (select vec_id, p, v[p * 16 + 1 : p * 16 + 16] as x from kept, range(4) t(p)),
b0 as materialized (select p, row_number() over (partition by p order by vec_id) - 1 as e, x from parts qualify e < 256),"""
    + "".join(map(_code_round, range(4)))
    + """
z as (select vec_id, p, min({'d': list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint, 'e': b.e}) as m from parts p join b4 b using (p) group by all),
c as (select vec_id, string_agg(lower(printf('%02x', m.e)), '' order by p) as code, sum(m.d)::bigint as error from z group by vec_id),
h as (select sha256(string_agg(array_to_string(x, ','), ',' order by p, e)) as codebooks_sha256 from b4)
select vec_id, code, error, sum(error) over (partition by label)::bigint as label_error, codebooks_sha256 from c join kept using (vec_id), h
"""
)

ORACLES = {"op4_decontamination": DECONTAMINATION, "op7_chat_format": CHAT, "op8_exact_dedup": EXACT_DEDUP, "op10_mixing": MIXING, "op11_collocations": COLLOCATIONS, "op12_top_k": TOP_K, "op13_vector_codes": CODES}
