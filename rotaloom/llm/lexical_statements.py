"""SQL statement of the lexical search."""

from __future__ import annotations

_TERMS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
)

OP13 = f"""
with d as (select doc_id, {_TERMS} as words from documents),
g as (select count(*)::bigint as nd, sum(len(words))::bigint as nl from d where len(words) > 0),
t as (select doc_id, len(words)::bigint as n, unnest(words) as term from d),
p as (select doc_id, n, term, count(*) as tf from t group by all),
w as (
  select term, floor(1000 * ln((2 * any_value(nd) + 2)::double / (2 * count(*) + 1)::double))::bigint as w
  from p cross join g group by term),
q as (select item_id, unnest({_TERMS}) as term from (select distinct item_id, text from benchmark)),
k as (select item_id, term, count(*) as k from q group by all),
s as (
  select item_id, doc_id,
         sum(k * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nd) // nl))))::bigint as score
  from k join p using (term) join w using (term) cross join g group by item_id, doc_id),
r as (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from s where score > 0)
select item_id, rank::int as rank, doc_id, score from r where rank <= 20
"""
