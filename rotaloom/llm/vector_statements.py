"""SQL statements of the vector queries."""

from __future__ import annotations

OP11 = """
with recursive v as (
  select vec_id, embedding::double[] as x from embeddings
  where embedding is not null and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0
    and len(list_filter(embedding, lambda c: c <> 0)) > 0),
l as (select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id and list_cosine_similarity(a.x, b.x) >= 0.95),
r as (select a, a as b from (select distinct a from l) union select r.a, l.b from r join l on r.b = l.a),
c as (select a, min(b) as component_id from r group by a),
n as (select a, count(*) as n_links from l group by a)
select vec_id, coalesce(n_links, 0)::bigint as n_links, coalesce(component_id, vec_id) as component_id,
       vec_id = coalesce(component_id, vec_id) as kept
from embeddings left join c on c.a = vec_id left join n on n.a = vec_id
"""

_FIRST = """
with v as (
  select vec_id, label, list_transform(embedding::double[], lambda c: floor(1024 * c)::bigint) as x,
         row_number() over (order by vec_id) - 1 as nr
  from embeddings
  where embedding is not null and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0),
p as (select vec_id, nr, unnest(x) as x, unnest(range(len(x))) // (len(x) // 4) as part, unnest(range(len(x))) % (len(x) // 4) as place from v),
b0 as (select part, nr as entry, place, x from p where nr < 256),
"""

_ASSIGN = """
d{i} as (
  select vec_id, p.part, entry, sum((p.x - b.x) * (p.x - b.x))::bigint as d
  from p join b{i} b on p.part = b.part and p.place = b.place group by all),
a{i} as (
  select vec_id, part, (min(d * 256 + entry) % 256)::bigint as entry, (min(d * 256 + entry) // 256)::bigint as d
  from d{i} group by all),
"""

_TRAIN = """
s{j} as (
  select p.part, entry, place, sum(x)::bigint as s, count(*) as n
  from p join a{i} using (vec_id, part) group by all),
b{j} as (
  select b.part, b.entry, b.place, coalesce((s - ((s % n) + n) % n) // n, b.x)::bigint as x
  from b{i} b left join s{j} using (part, entry, place)),
"""

_LAST = """
e as (
  select vec_id, string_agg(printf('%02x', entry), '' order by part) as code, sum(d)::bigint as error
  from a{i} group by vec_id),
h as (select sha256(string_agg(x::varchar, ',' order by part, entry, place)) as codebooks_sha256 from b{i})
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256
from e join v using (vec_id) cross join h
"""


def _trained(rounds: int = 4) -> str:
    steps = [_ASSIGN.format(i=i) + _TRAIN.format(i=i, j=i + 1) for i in range(rounds)]
    return _FIRST + "".join(steps) + _ASSIGN.format(i=rounds) + _LAST.format(i=rounds)


OP12 = _trained()
