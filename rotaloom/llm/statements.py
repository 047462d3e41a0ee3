"""SQL statements with the rows that the queries must give."""

from __future__ import annotations

from rotaloom.llm.lexical_statements import OP13
from rotaloom.llm.vector_statements import OP11, OP12

OP2 = """
with t as (select doc_id, coalesce(text, '') as body from documents),
g as (select body, max(doc_id) as keep_id, count(*) as group_size from t group by body)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(body) as text_sha256
from t join g using (body)
"""

OP4 = r"""
with d as (
  select doc_id, lang, source, row_number() over () as rid, coalesce(text, '') as body,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines
  from documents),
g as (select rid, words, unnest(range(1, len(words) - 1)) as i from d where len(words) >= 3),
hh as (select rid, i, count(*) over (partition by rid, words[i], words[i + 1], words[i + 2]) as k from g),
rep as (select rid, count(distinct p)::bigint as n from (select rid, unnest([i, i + 1, i + 2]) as p from hh where k > 1) group by rid),
f as (
  select doc_id, lang, source, len(words)::bigint as n_words,
         coalesce(list_sum(list_transform(words, lambda w: length(w))), 0)::bigint as word_chars,
         len(regexp_extract_all(body, '[#*$%&|<>]'))::bigint as n_symbols,
         len(lines)::bigint as n_lines, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
         coalesce(n, 0)::bigint as n_repeat_words
  from d left join rep using (rid)),
b as (
  select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
         (word_chars * 100) // nullif(n_words, 0) as m1, (greatest(n_symbols - 1, 0) * 1000) // nullif(n_words, 0) as m2,
         (greatest(n_dup_lines - 1, 0) * 1000) // nullif(n_lines, 0) as m3, (greatest(n_repeat_words - 6, 0) * 1000) // nullif(n_words, 0) as m4
  from f),
v as (select lang, source, unnest([1, 2, 3, 4]) as m, unnest([m1, m2, m3, m4]) as x from b where not base_failed),
k as (
  select lang, source, m,
         case when x < 64 then x else (length(bin(x)) - 6) * 32 + (x >> (length(bin(x)) - 6)) end as bucket
  from v),
lv as (
  select 0 as lv, lang, source, m, bucket from k union all
  select 1, lang, null, m, bucket from k union all
  select 2, null, null, m, bucket from k),
c as (select lv, lang, source, m, bucket, count(*) as n from lv group by all),
u as (
  select *, sum(n) over (partition by lv, lang, source, m order by bucket) as upto,
         sum(n) over (partition by lv, lang, source, m) as total
  from c),
q as (
  select lv, lang, source, m, any_value(total)::bigint as n, p, min(bucket)::bigint as k
  from u cross join (select unnest([10, 50, 90]) as p) where 100 * upto >= p * total group by lv, lang, source, m, p),
w as (select *, case when k < 64 then k else ((k - (k // 32 - 1) * 32 + 1) << (k // 32 - 1)) - 1 end as x from q),
s as (select distinct lang, source from b),
t as (
  select s.lang, s.source, a2.m, a2.p,
         (coalesce(a0.n * a0.x, 0) + 100 * ((coalesce(a1.n * a1.x, 0) + 100 * a2.x) // (coalesce(a1.n, 0) + 100)))
         // (coalesce(a0.n, 0) + 100) as x
  from s cross join (from w where lv = 2) a2
  left join (from w where lv = 0) a0
    on a0.m = a2.m and a0.p = a2.p and a0.lang is not distinct from s.lang and a0.source is not distinct from s.source
  left join (from w where lv = 1) a1 on a1.m = a2.m and a1.p = a2.p and a1.lang is not distinct from s.lang),
h as (
  select lang, source, m, max(case when p = 10 then x end) as p10, max(case when p = 50 then x end) as p50,
         max(case when p = 90 then x end) as p90
  from t group by lang, source, m),
l as (
  select lang, source,
         max(case when m = 1 then p10 - 3 * (p50 - p10) end)::bigint as low_word_length,
         max(case when m = 1 then p90 + 3 * (p90 - p50) end)::bigint as high_word_length,
         max(case when m = 2 then p90 + 3 * (p90 - p50) end)::bigint as high_symbols,
         max(case when m = 3 then p90 + 3 * (p90 - p50) end)::bigint as high_dup_lines,
         max(case when m = 4 then p90 + 3 * (p90 - p50) end)::bigint as high_repeats
  from h group by lang, source)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       coalesce(not base_failed and m1 between low_word_length and high_word_length and m2 <= high_symbols
                and m3 <= high_dup_lines and m4 <= high_repeats, false) as kept,
       low_word_length, high_word_length, high_symbols, high_dup_lines, high_repeats
from b left join l on b.lang is not distinct from l.lang and b.source is not distinct from l.source
"""

OP8 = r"""
with d as (
  select doc_id, source, md5('mix:' || doc_id) as k,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size
  from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
r as (select *, row_number() over (order by source nulls last) - 1 as nr from s),
w as (select *, [3, 1, 2][(nr % 3 + 1)::int] as weight from r),
f as (
  select *, 2 * source_size / weight as ratio,
         ((sum(source_size) over ())::double * 3 / 2
          - coalesce(sum(2 * source_size) over (order by 2 * source_size / weight, nr rows between unbounded preceding and 1 preceding), 0)::double)
         / (sum(weight) over (order by 2 * source_size / weight, nr rows between current row and unbounded following))::double as lv
  from w),
t as (
  select *, least((2 * source_size)::double,
                  weight * coalesce(max(case when lv <= ratio then lv end) over (), ratio)) as target
  from f),
q as (
  select doc_id, size, source_size, target, nr,
         coalesce(sum(size) over (partition by nr order by k, doc_id rows between unbounded preceding and 1 preceding), 0)::bigint as before
  from d join t on d.source is not distinct from t.source),
c as (
  select *, coalesce(floor(target / nullif(source_size, 0)), 0)::bigint as passes, [0.5, 0.0, -0.5][(nr % 3 + 1)::int]::double as slope
  from q),
e as (
  select *, passes + case when before * 2 + size < (target - passes * source_size) * 2 then 1 else 0 end as copies,
         coalesce(before / nullif(target, 0), 0) as share
  from c)
select doc_id, size, source_size, target, copies * size as taken,
       case when copies > 0 then round(least(1.0, case when slope = 0 then share else
         (sqrt((1 - slope) * (1 - slope) + slope * share * 4) - (1 - slope)) / (slope * 2) end), 9) end as position
from e
"""


def sql() -> dict[str, str]:
    return {
        "op2_exact_dedup": OP2,
        "op4_quality_rules": OP4,
        "op8_mixing": OP8,
        "op11_vector_join": OP11,
        "op12_vector_codes": OP12,
        "op13_lexical_search": OP13,
    }
