"""DuckDB SQL for the queries that SQL can express on whole tables."""

from __future__ import annotations

from loomline.llm.licences import RULES, known


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _canonical(column: str) -> str:
    out = f"lower({column})"
    for pattern, to in RULES:
        out = f"regexp_replace({out}, {_quoted(pattern)}, {_quoted(to.replace('$', chr(92)))}, 'g')"
    return f"trim(regexp_replace({out}, ' +', ' ', 'g'))"


OP10 = f"""
with k(id, text) as (values {", ".join(f"({_quoted(i)}, {_quoted(t)})" for i, t in known())}),
t as (select sha256({_canonical("text")}) as digest, min(id) as licence from k group by 1),
d as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
u as (
  select r, true as whole, text as part from d
  union all select distinct r, false, unnest(list_distinct(regexp_split_to_array(text, '\\n') || regexp_split_to_array(text, '\\n *\\n'))) from d
),
f as (
  select r, max(licence) filter (where whole) as licence, string_agg(distinct licence, ',' order by licence) filter (where not whole) as declared, count(distinct u.digest) filter (where not whole) as n
  from (select r, whole, sha256({_canonical("part")}) as digest from u) u join t using (digest) group by r
)
select doc_id, licence, coalesce(declared, '') as declared, cast(coalesce(n, 0) as bigint) as n_declared from d left join f using (r)
"""

OP4 = r"""
with d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
), b as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark
), win as (
  select distinct cast(item_id as varchar) as item, least(10, len(w)) as k, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') as g
  from (select item_id, w, unnest(range(1, greatest(2, len(w) - 8))) as i from b where len(w) > 0)
), ks as (select distinct k from win
), occ as (
  select doc_id, p, k, array_to_string(w[p : p + k - 1], ' ') as g
  from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as p from d, ks where len(w) >= k)
), hit as (select o.doc_id, o.p, o.k, win.item from occ o join win on o.k = win.k and o.g = win.g
), pos as (select doc_id, count(distinct q) as n_hit from (select doc_id, unnest(range(p, p + k)) as q from hit) group by doc_id
), its as (select doc_id, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as items from hit group by doc_id
)
select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join pos using (doc_id) left join its using (doc_id)
"""

OP9 = r"""
with d as (
  select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size, strlen(coalesce(text, '')) as bytes,
    concat_ws(':', coalesce(cast(doc_id as varchar), ''), md5(coalesce(text, ''))) as id
  from documents
), k as (
  select *, -ln((cast(('0x' || substr(md5('17:' || id), 1, 13)) as bigint) + 0.5::double) / 4503599627370496.0::double)
    / (case when bytes / greatest(size, 1) between 4 and 12 then 1.0::double else 0.5::double end * case when size >= 20 then 1.0::double else 0.5::double end) as key
  from d
), s as (
  select source, cast(sum(size) as bigint) as source_size, 1 + (row_number() over (order by source is null, source) - 1) % 3 as weight from d group by source
), l as (
  select *, 3.0::double * source_size as most,
    (sum(source_size) over () - coalesce(sum(3.0::double * source_size) over (order by 3.0::double * source_size / weight, source is null, source rows between unbounded preceding and 1 preceding), 0))
    / (sum(weight) over () - coalesce(sum(weight) over (order by 3.0::double * source_size / weight, source is null, source rows between unbounded preceding and 1 preceding), 0)) as level
  from s
), f as (select min(level) filter (where most > level * weight) as level, count(*) filter (where most > level * weight) as open from l
), t as (
  select source, source_size, case when l.most <= l.level * weight or f.open = 0 then l.most
    else least(l.most, (select arg_min(x.level, x.most / x.weight) from l x where x.most > x.level * x.weight) * weight) end as target
  from l, f
), e as (
  select *, case when source_size > 0 then cast(floor(round(target / source_size, 9)) as bigint) else 0 end as epochs from t
), c as (
  select k.*, e.source_size, e.target, e.epochs, greatest(0, e.target - e.epochs * e.source_size) as rest,
    sum(k.size) over (partition by k.source order by k.key, k.id) as upto
  from k join e on k.source is not distinct from e.source
), g as (select source, max(rest) - coalesce(max(upto) filter (where upto <= rest), 0) as gap from c group by source
), p as (
  select c.source, arg_min(c.id, row(abs(c.size - g.gap), c.key, c.id)) as fill
  from c join g on c.source is not distinct from g.source where c.upto > c.rest and abs(c.size - g.gap) < g.gap group by c.source
)
select c.doc_id, c.size, c.source_size, c.target, cast(c.size * (c.epochs + case when c.upto <= c.rest or coalesce(c.id = p.fill, false) then 1 else 0 end) as bigint) as taken
from c left join p on c.source is not distinct from p.source
"""

OP8 = r"""
with p as (
  select page_id, strlen(coalesce(html, '')) as n, sha1(coalesce(html, '')) as h, min(page_id) over (partition by coalesce(html, '')) as first from pages
), b as (
  select *, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + cast(((cast('0x' || substr(h, 5 * (i // 4) + 1, 5) as bigint) >> (15 - 5 * (i % 4))) & 31) as bigint), 1)), '') as digest from p
)
select page_id, cast(n as bigint) as payload_bytes, digest as payload_digest, case when first = page_id or first is null then 'response' else 'revisit' end as record_type,
  case when first = page_id then null else first end as refers_to
from b
"""

OP12 = r"""
with t as (
  select doc_id, translate(t.term, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as term
  from (select doc_id, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from documents) t
), tf as (
  select doc_id, term, count(*) as tf from t group by all
), doc as (
  select doc_id, sum(tf)::bigint as n from tf group by doc_id
), total as (
  select count(*) as docs, sum(n)::bigint as words from doc
), weighed as (
  select term, floor(1000 * ln((2 * any_value(docs) + 2)::double / (2 * count(*) + 1)))::bigint as w from tf, total group by term
), asked as (
  select item_id, translate(unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as term from benchmark
), uses as (
  select item_id, term, count(*) as times from asked group by all
), scored as (
  select item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // words))))::bigint as score
  from uses join weighed using (term) join tf using (term) join doc using (doc_id), total group by item_id, doc_id
), ranked as (
  select item_id, row_number() over (partition by item_id order by score desc, doc_id) as rank, doc_id, score from scored where score > 0
)
select item_id, cast(rank as integer) as rank, doc_id, score from ranked where rank <= 20
"""

SQL: dict[str, str] = {"op10_licences": OP10, "op8_warc": OP8, "op4_decontamination": OP4, "op9_mixing": OP9, "op12_ranked_search": OP12}
