"""DuckDB SQL for the queries that SQL can express."""

WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

SQL = {
    "op3_mix_sources": f"""
with d as (
  select doc_id, source, {WORDS}::bigint as size, md5(coalesce(cast(doc_id as varchar), 'null:' || md5(coalesce(text, '')))) as h from documents
), s as (
  select source, (source is null) as no_source, sum(size)::bigint as source_size from d group by source
), w as (
  select *, case (row_number() over (order by no_source, source) - 1) % 3 when 0 then 5 when 1 then 2 else 1 end as weight from s
), r as (
  select *, (3 * source_size)::double / weight as ratio, sum(source_size) over () as total from w
), c as (
  select *, 3 * source_size * (sum(weight) over () - coalesce(sum(weight) over b, 0))
     <= weight * (total - coalesce(sum(3 * source_size) over b, 0)) as capped
  from r window b as (order by ratio, no_source, source rows between unbounded preceding and 1 preceding)
), t as (
  select source, source_size, case when capped then (3 * source_size)::double else weight * (total
     - sum(case when capped then 3 * source_size else 0 end) over ())::double
     / greatest(sum(case when capped then 0 else weight end) over (), 1) end as target from c
), q as (
  select d.doc_id, d.source, d.size, d.h, t.source_size, t.target,
    sum(size) over (partition by d.source order by h, doc_id, size rows between unbounded preceding and current row) as fin
  from d join t on d.source is not distinct from t.source
), k as (
  select q.*, g.r, (fin + g.r * source_size)::double / target as finish
  from q cross join (values (0), (1), (2)) g(r) where size > 0 and target > 0
), o as (
  select *, sum(size) over (order by finish, source is null, coalesce(source, ''), h, doc_id, size, r rows between unbounded preceding and current row) as run from k
), n as (
  select doc_id, count(*) as copies from o where run <= (select sum(size) from d) group by doc_id
)
select q.doc_id, q.size, q.source_size, q.target, (coalesce(n.copies, 0) * q.size)::bigint as taken, q.source
from q left join n on q.doc_id = n.doc_id
""",
    "op4_token_rollup": r"""
with l as (select doc_id, min(quality) as quality, max(toxic) as toxic from labels group by doc_id),
d as (
  select documents.doc_id, source, lang, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as words,
    len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]+|[^A-Za-z0-9\x20\x09-\x0D]')) as pieces,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]{2,}')) as long_words, quality, toxic
  from documents left join l on documents.doc_id = l.doc_id
)
select source, lang, tokenizer, count(*)::bigint as docs, sum(tokens)::bigint as tokens from (
  select source, lang, 'words' as tokenizer, case when quality = 0 then long_words else words end as tokens from d where coalesce(toxic, 0) <> 1
  union all select source, lang, 'pieces', pieces from d where coalesce(toxic, 0) <> 1
) group by source, lang, tokenizer
""",
    "op5_pivot_top_k": """
with e as (
  select row_number() over () as k, vec_id, embedding from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), v as (
  select k, generate_subscripts(embedding, 1) as i, floor(1024 * unnest(embedding)::double)::bigint as x from e
), p as (
  select q.k as q, v.k as k, sum(q.x * v.x)::bigint as score from v q join v on q.i = v.i where q.k in (select k from e where vec_id % 100 = 0) group by 1, 2
), r as (
  select q.vec_id as query_id, cast(row_number() over (partition by q.k order by coalesce(p.score, 0) desc, e.vec_id) as integer) as rank, e.vec_id, coalesce(p.score, 0) as score
  from e q join e on q.vec_id % 100 = 0 and q.k <> e.k left join p on p.q = q.k and p.k = e.k
)
select query_id, rank, vec_id, score from r where rank <= 10
""",
    "op11_hard_negatives": """
with e as (
  select row_number() over () as k, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, embedding from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), v as (
  select k, generate_subscripts(embedding, 1) as i, floor(256 * unnest(embedding)::double)::bigint as x from e
), p as (
  select a.k as a, b.k as b, sum(a.x * b.x)::bigint as score from v a join v b on a.i = b.i where a.k in (select k from e where vec_id % 100 = 0) group by 1, 2
), s as (
  select a.k as a, b.k as b, a.vec_id as anchor_id, b.vec_id as id, a.label = b.label as same, coalesce(p.score, 0) as score
  from e a join e b on a.vec_id % 100 = 0 and a.k <> b.k left join p on p.a = a.k and p.b = b.k
), g as (
  select * from (select *, row_number() over (partition by a order by score desc, id) as r from s where same) where r <= 5
), n as (
  select g.anchor_id, g.id as positive_id, cast(row_number() over (partition by g.a, g.b order by s.score desc, s.id) as integer) as rank, s.id as negative_id, g.score as positive_score, s.score as negative_score
  from g join s on s.a = g.a and not s.same and 80 * g.score <= 100 * s.score and 100 * s.score <= 100 * g.score
)
select * from n where rank <= 5
""",
    "op13_warc": """
with p as (
  select page_id, url, strlen(coalesce(html, ''))::bigint as payload_bytes, sha1(coalesce(html, '')) as h, max(page_id) over (partition by coalesce(html, '')) as leader from pages
), t as (select *, list_transform(range(0, 8), lambda k: ('0x' || h[5 * k + 1 : 5 * k + 5])::integer) as twenty from p)
select page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (twenty[1 + i // 4] >> (15 - 5 * (i % 4))) % 32, 1)), '') as payload_digest,
  case when page_id = leader then 'response' else 'revisit' end as record_type, case when page_id <> leader then leader end as refers_to, url
from t
""",
}
