"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontam, langid, lines, mix, quality, shard, simhash, suffix_dedup, topk, warc
from .common import table


def op1_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard.shard_report(table(spark, sf_dir, "documents"), 40)


def op4_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_report(table(spark, sf_dir, "documents"))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k_report(table(spark, sf_dir, "embeddings"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_report(table(spark, sf_dir, "documents"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.mix_report(table(spark, sf_dir, "documents"))


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_report(table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicate_report(table(spark, sf_dir, "documents"))


def op10_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.revisit_report(table(spark, sf_dir, "pages"))


QUERIES = {"op1_shard": op1_shard, "op2_langid": op2_langid, "op3_simhash": op3_simhash, "op4_lines": op4_lines, "op5_topk": op5_topk, "op6_quality": op6_quality, "op7_suffix": op7_suffix, "op8_decontaminate": op8_decontaminate, "op9_mix": op9_mix, "op10_revisits": op10_revisits}
ORACLE: dict[str, str] = {
    "op4_lines": r"""
with recursive l as (
  select doc_id, i - 1 as line, parts[i] as x
  from (select doc_id, string_split(text, chr(10)) as parts from documents where text is not null), unnest(range(1, len(parts) + 1)) t(i)
), real as (
  select * from l where regexp_matches(x, '\S')
), kind as (
  select x, min(struct_pack(d := doc_id, n := line)) as first, row_number() over (order by min(struct_pack(d := doc_id, n := line))) as id, len(x) as size
  from real group by x
), pair as materialized (
  select a.id as u, b.id as v, a.x as x, b.x as y, a.size // 3 as t
  from kind a join (select id, x, size + d as s from kind, unnest(range(-2, 3)) t(d) where size >= 20) b on a.size = b.s and a.id < b.id
  where a.size >= 20
), near as materialized (
  select * from pair where contains(y, left(x, t)) or contains(y, substr(x, t + 1, t)) or contains(y, substr(x, 2 * t + 1))
), met as materialized (
  select u, v from near where levenshtein(x, y) <= 2
), link as (
  select u, v from met union all select v, u from met
), reach as (
  select id as u, id as v from kind where id in (select u from link)
  union
  select reach.u, link.v from reach join link on reach.v = link.u
), root as (
  select u as id, min(v) as root from reach group by u
), many as (
  select u as id, count(*) as n from link group by u
), class as (
  select k.x, coalesce(m.n, 0) as n, f.first from kind k left join many m using (id) left join root r using (id) join kind f on f.id = coalesce(r.root, k.id)
), judged as (
  select real.doc_id, real.line, class.n, class.first, class.first.d = real.doc_id and class.first.n = real.line as stays from real join class using (x)
), found as (
  select doc_id, count(*) as n_lines, sum(n) as n_links,
    coalesce(list(line order by line) filter (not stays), []) as lost, coalesce(list(first.d order by line) filter (not stays), []) as docs, coalesce(list(first.n order by line) filter (not stays), []) as heads
  from judged group by doc_id
)
select d.doc_id, coalesce(n_lines, 0)::int as n_lines, coalesce(len(lost), 0)::int as n_removed, coalesce(lost, [])::int[] as removed_lines,
  coalesce(docs, [])::bigint[] as class_docs, coalesce(heads, [])::int[] as class_lines, coalesce(n_links, 0)::bigint as n_links
from documents d left join found using (doc_id)
""",
    "op7_suffix": """
with d as (
  select doc_id, hex(encode(coalesce(text, ''))) as h, octet_length(encode(coalesce(text, '')))::bigint as n from documents
), w as (
  select doc_id, i, md5_number(substr(h, 2 * i + 1, 200)) as s from d, unnest(range(0, n - 99)) t(i)
), gone as (
  select doc_id, i from (select doc_id, i, row_number() over (partition by s order by doc_id, i) as k from w) where k > 1
), new as (
  select doc_id, i, case when i - lag(i) over (partition by doc_id order by i) <= 100 then 0 else 1 end as starts from gone
), numbered as (
  select doc_id, i, sum(starts) over (partition by doc_id order by i) as span from new
), spans as (
  select doc_id, min(i) as a, max(i) + 100 as b from numbered group by doc_id, span
), gaps as (
  select doc_id, a, b, lag(b, 1, 0) over (partition by doc_id order by a) as p from spans
), lost as (
  select g.doc_id, sum(b - a)::bigint as n_removed, count(*) as n_spans, string_agg(substr(h, 2 * p + 1, 2 * (a - p)), '' order by a) || substr(any_value(h), 2 * max(b) + 1) as kept
  from gaps g join d using (doc_id) group by g.doc_id
)
select d.doc_id, d.n as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans, sha256(unhex(coalesce(kept, h))) as kept_sha256
from d left join lost using (doc_id)
""",
    "op9_mix": r"""
with d as (
  select doc_id, source, md5(concat_ws(':', '7', doc_id::varchar, md5(text))) as place, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size from documents
), sources as (
  select source, sum(size)::bigint as source_size, row_number() over (order by source is null, source) - 1 as k from d group by source
), weighed as (
  select *, case k % 3 when 0 then 3.0::double when 1 then 1.0::double else 2.0::double end as weight, 2.0::double * source_size as cap from sources
), filled as (
  select *, coalesce(sum(cap) over (order by cap / weight, k rows between unbounded preceding and 1 preceding), 0) as capped,
    sum(weight) over (order by cap / weight, k rows between current row and unbounded following) as free, 1.5::double * (select sum(source_size) from sources) as total
  from weighed where source_size > 0
), level as (
  select max((total - capped) / free) as level from filled
), goals as (
  select source, source_size, case when source_size > 0 then least(cap, weight * level) else 0 end as target from weighed, level
), queue as (
  select d.*, g.source_size, g.target, sum(size) over (partition by d.source order by place, doc_id) as sent from d join goals g on d.source is not distinct from g.source
), entries as (
  select doc_id, size, source, sent, e, (sent + e * source_size)::double / target as finish from queue, range(0, 2) t(e) where size > 0 and target > 0
), served as (
  select *, sum(size) over (order by finish, source nulls first, sent, e rows unbounded preceding) as so_far from entries
), taken as (
  select doc_id, count(*) as n from served where so_far <= 1.5 * (select sum(source_size) from sources) group by doc_id
)
select q.doc_id, q.size, q.source_size, q.target, (q.size * coalesce(t.n, 0))::bigint as taken from queue q left join taken t using (doc_id)
""",
    "op5_topk": """
with v as (
  select vec_id::bigint as vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings
  where embedding is not null and vec_id is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select q.vec_id as query_id, c.vec_id as vec_id, list_dot_product(q.v, c.v)::bigint as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0
), ranked as (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored
)
select query_id, rank::int as rank, vec_id, score from ranked where rank <= 5
""",
    "op10_revisits": """
with p as (
  select page_id, url, md5(coalesce(html, '')) as tag, 'day ' || (page_id % 28) as day, octet_length(encode(html))::varchar as size,
    regexp_replace(trim(url), '#.*$', '') as bare
  from pages
), k as (
  select *, lower(regexp_extract(bare, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) as scheme,
    regexp_replace(bare, '^[A-Za-z][A-Za-z0-9+.-]*://', '') as rest from p
), h as (
  select *, lower(regexp_replace(regexp_extract(rest, '^([^/?]*)', 1), '^.*@', '')) as host,
    regexp_extract(rest, '^[^/?]*([^?]*)', 1) as path,
    array_to_string(list_sort(string_split(regexp_extract(rest, '\\?(.*)$', 1), '&')), '&') as query from k
), u as (
  select *, regexp_replace(case when scheme = 'https' then regexp_replace(host, ':443$', '') else regexp_replace(host, ':80$', '') end, '^www[0-9]*\\.', '')
    || case when path = '' then '/' else path end || case when query = '' then '' else '?' || query end as url_key from h
), r as (
  select url_key, page_id, page_id * 60 as sec, '"' || tag || '"' as etag, day, size from u
), v as (
  select page_id, url_key, 1 as n, page_id * 60 + 86400 as sec, 'W/"' || tag || '"' as etag, null as day, 'later' as date_field, null as cache_control from u
  union all
  select page_id, url_key, 2, page_id * 60 + 172800, case when page_id % 5 = 0 then '"other"' when page_id % 3 <> 0 then '"' || tag || '"' end, day, null, 'max-age=60' from u
  union all
  select page_id, url_key, 3, page_id * 60 - 315360000, '"' || tag || '"', null, null, null from u
), found as (
  select v.*, r.page_id as rid, r.sec as rsec, r.etag as retag, r.day as rday, r.size as rsize,
    row_number() over (partition by v.page_id, v.n order by r.sec desc nulls last, r.page_id::varchar || ':0' desc) as k
  from v left join r on r.url_key = v.url_key and r.sec < v.sec
), judged as (
  select *, case when rid is null then 'missing'
    when etag is not null then case when regexp_replace(etag, '^W/', '') = retag then 'resolved' else 'mismatch' end
    when day is not null then case when day = rday then 'resolved' else 'mismatch' end
    else 'unvalidated' end as outcome
  from found where k = 1
)
select page_id || ':' || n as record_id, page_id, url_key, outcome,
  case when outcome in ('resolved', 'unvalidated') then rid || ':0' end as response_id,
  case when outcome in ('resolved', 'unvalidated') then (sec - rsec)::bigint end as age_s,
  case when outcome in ('resolved', 'unvalidated') then coalesce(etag, retag) end as etag,
  case when outcome in ('resolved', 'unvalidated') then date_field end as date_field,
  case when outcome in ('resolved', 'unvalidated') then cache_control end as cache_control,
  case when outcome in ('resolved', 'unvalidated') then rsize end as content_length
from judged
""",
}
