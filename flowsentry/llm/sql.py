"""DuckDB SQL that gives the rows of the queries on whole tables."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

DECONTAMINATE = rf"""
with d as (
  select row_number() over () as n, doc_id,
         regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (
  select item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
i as (select *, least(10, len(w)) as size from b where len(w) > 0),
windows as (
  select distinct item_id, size, array_to_string(w[k:k + size - 1], ' ') as s
  from (select *, unnest(range(1, len(w) - size + 2)) as k from i)),
places as (
  select n, size, k, array_to_string(w[k:k + size - 1], ' ') as s
  from (select n, size, w, unnest(range(1, len(w) - size + 2)) as k
        from d cross join (select distinct size from windows) where len(w) >= size)),
hits as (select n, k, size, item_id from places join windows using (size, s)),
words as (select n, count(distinct p) as n_hit from (select n, unnest(range(k, k + size)) as p from hits) group by n),
items as (select n, list_sort(list(distinct coalesce(item_id::varchar, ''))) as names from hits group by n)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(len(names), 0) as n_items,
       sha256(coalesce(array_to_string(names, ','), '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join words using (n) left join items using (n)
"""

JACCARD = rf"""
with recursive d as (
  select row_number() over () as n, doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') as w from documents),
s as (
  select distinct n, array_to_string(w[k:k + 4], ' ') as t
  from (select n, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as k from d where len(w) > 0)),
z as (select n, count(*) as size from s group by n),
c as (select a.n as a, b.n as b, count(*) as common from s a join s b on a.t = b.t and a.n < b.n group by all),
e as (
  select a, b from c join z x on x.n = a join z y on y.n = b where 100 * common >= 75 * (x.size + y.size - common)),
edges as (select a, b from e union all select b, a from e),
reach(n, m) as (select n, n from d union select reach.n, edges.b from reach join edges on edges.a = reach.m),
least_id as (select reach.n, min(o.doc_id) as component_id from reach join d o on o.n = reach.m group by reach.n)
select doc_id, coalesce(size, 0) as n_shingles, component_id
from d join least_id using (n) left join z using (n)
"""
