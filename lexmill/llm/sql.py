"""SQL twins of the queries that SQL can express (DuckDB dialect)."""

MIX = r"""
with d as (
    select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
           (('0x' || substr(md5(coalesce(doc_id::varchar, '') || '|' || sha256(coalesce(text, '')) || '|' ||
               (row_number() over (partition by source, coalesce(doc_id::varchar, ''), coalesce(text, '')) - 1)), 1, 13))::ubigint::double + 0.5) / 4503599627370496.0 as u
    from documents
), p0 as (
    select source, sum(size)::bigint as total, count(*) as n from d group by source
), p1 as (
    select *, [5.0, 2.0, 1.0][((row_number() over (order by source is null, source) - 1) % 3 + 1)::int]::double as w, total * 2.0::double as cap from p0
), p2 as (
    select *, cap / w as r,
           (sum(total) over () * 1.5::double - coalesce(sum(cap) over (order by cap / w, source is null, source rows between unbounded preceding and 1 preceding), 0))
           / sum(w) over (order by cap / w, source is null, source rows between current row and unbounded following) as level
    from p1
), lv as (
    select level from p2 where level <= r order by r, source is null, source limit 1
), p3 as (
    select source, total, n, coalesce(least(cap, (select level from lv) * w), cap) as target from p2
), p4 as (
    select *, case when total > 0 then target / total else 0.0::double end as ratio from p3
), q as (
    select d.*, p.total, p.target, floor(p.ratio) as whole, p.target - floor(p.ratio) * p.total as want,
           case when p.ratio - floor(p.ratio) > 0 then
             d.u / (1.0::double - d.u) / ((p.ratio - floor(p.ratio)) / (1.0::double - (p.ratio - floor(p.ratio)))
               * sqrt((1.0::double + d.size) / (1.0::double + p.total::double / p.n))) end as rnk
    from d join p4 p on d.source is not distinct from p.source
), t as (
    select *, sum(size) over (partition by source order by rnk nulls last, doc_id nulls first, size rows between unbounded preceding and current row) - size as before from q
)
select doc_id, size, total as source_size, target,
       (size * (whole + case when rnk is not null and before + size / 2.0::double < want then 1 else 0 end))::bigint as taken
from t
"""

TOP_K = """
with ok as (
    select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
    where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
    select q.vec_id as query_id, c.vec_id, list_dot_product(q.v, c.v)::bigint as score
    from ok q join ok c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id
), r as (
    select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s
)
select query_id, rank::int as rank, vec_id, score from r where rank <= 5
"""

WARC = """
with p as (
    select page_id, coalesce(html, '') as html from pages
), d as (
    select page_id, octet_length(encode(html)) as payload_bytes, sha1(html) as sha from p
), g as (
    select *, max(page_id) over (partition by sha, payload_bytes) as keeper from d
)
select page_id, payload_bytes::bigint as payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           ((('0x' || substr(sha, (i // 4 * 5 + 1)::int, 5))::bigint >> (15 - 5 * (i % 4))::int) & 31)::int + 1, 1)), '') as payload_digest,
       case when page_id is not distinct from keeper then 'response' else 'revisit' end as record_type,
       case when page_id is distinct from keeper then keeper end as refers_to
from g
"""

JACCARD = r"""
with recursive w as (
    select doc_id, row_number() over () as r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
    from documents
), s as (
    select distinct doc_id, r, case when len(w) < 3 then array_to_string(w, ' ') else array_to_string(w[i:i + 2], ' ') end as g
    from (select doc_id, r, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) as i from w where len(w) > 0)
), n as (
    select doc_id, r, count(*) as n from s group by doc_id, r
), c as (
    select a.r as a, b.r as b, count(*) as common from s a join s b on a.g = b.g and a.r < b.r group by a.r, b.r
), l as (
    select a, b from c join n x on x.r = a join n y on y.r = b where 100 * common >= 90 * (x.n + y.n - common)
), e as (
    select a, b from l union all select b, a from l
), reach as (
    select r as a, r as b from w union select reach.a, e.b from reach join e on e.a = reach.b
), m as (
    select reach.a as r, min(w.doc_id) as component_id from reach join w on w.r = reach.b group by reach.a
)
select w.doc_id, coalesce(n.n, 0)::bigint as n_shingles, m.component_id
from w join m on m.r = w.r left join n on n.r = w.r
"""

# the components' statement with the number of links of each row
JACCARD_LINKS = JACCARD.replace("n_shingles, m.component_id", "n_shingles, m.component_id, (select count(*) from e where e.a = w.r)::bigint as n_links")

RANKED = r"""
with d as (
    select doc_id, row_number() over () as r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w
    from documents
), s as (
    select count(*)::bigint as docs, sum(len(w))::bigint as words from d where len(w) > 0
), f as (
    select r, t, count(*)::bigint as tf from (select r, unnest(w) as t from d) group by r, t
), idf as (
    select t, floor(1000 * ln((2 * docs + 2)::double / (2 * count(*) + 1)))::bigint as w from f, s group by t, docs
), b as (
    select item_id, row_number() over () as q, text from (select distinct item_id, text from benchmark)
), asked as (
    select item_id, q, t, count(*)::bigint as times from (
        select item_id, q, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as t from b
    ) group by item_id, q, t
), scored as (
    select a.item_id, a.q, d.doc_id, d.r, sum(a.times * idf.w * ((1000000000 * f.tf) // (1000 * f.tf + 8 * (100 - 75 + ((75 * len(d.w) * s.docs) // s.words)))))::bigint as score
    from asked a join idf using (t) join f using (t) join d on d.r = f.r, s
    group by a.item_id, a.q, d.doc_id, d.r
), ranked as (
    select *, row_number() over (partition by q order by score desc, doc_id nulls last) as rank from scored where score > 0
)
select item_id, rank::int as rank, doc_id, score from ranked where rank <= 10
"""

MIDDLE = r"""
with d as (
    select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as u,
           sha256('1:' || coalesce(doc_id::varchar, '')) as h from documents
), c as (
    select *, len(u)::bigint as n, (('0x' || h[1:8])::bigint % (len(u) + 1))::bigint as a, (('0x' || h[9:16])::bigint % (len(u) + 1))::bigint as b,
           case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or ('0x' || h[17:24])::bigint % 100 >= 90 then 'plain'
                when ('0x' || h[25:32])::bigint % 100 < 20 then 'spm' else 'psm' end as form
    from d
), p as (
    select doc_id, text, n, form, array_to_string(u[1:least(a, b)], '') as prefix, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') as middle,
           array_to_string(u[greatest(a, b) + 1:n], '') as suffix
    from c
)
select doc_id, n, form, case when form <> 'plain' then length(prefix) end::bigint as prefix_chars, case when form <> 'plain' then length(middle) end::bigint as middle_chars,
       sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256, sha256(text) as restored_sha256
from p
"""

NEAR_VECTORS = """
with recursive ok as (
    select row_number() over () as r, vec_id, label, embedding, embedding::double[] as v,
           coalesce(label is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
                    and len(list_filter(embedding, lambda x: x <> 0)) > 0, false) as sound
    from embeddings
), u as (
    select *, list_max(list_transform(v, lambda x: abs(x))) as top from ok where sound
), z as (
    select r, label, list_transform(v, lambda x: x / top) as v from u
), l as (
    select a.r as a, b.r as b from z a join z b on a.label = b.label and a.r <> b.r and len(a.v) = len(b.v)
    where list_dot_product(a.v, b.v) >= 0.93::double * sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))
), reach as (
    select r as a, r as b from ok union select reach.a, l.b from reach join l on l.a = reach.b
), m as (
    select reach.a as r, min(ok.vec_id) as component_id from reach join ok on ok.r = reach.b group by reach.a
)
select ok.vec_id, (select count(*) from l where l.a = ok.r)::bigint as n_links, m.component_id, ok.vec_id is not distinct from m.component_id as kept
from ok join m on m.r = ok.r
"""
