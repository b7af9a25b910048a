"""The registered queries of the corpus operators: each applies its operator to the whole of its table."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import audit, decontaminate, langid, licences, lines, packing, pii, quality, repetition, topk, toxicity, warc
from .common import table
from .minhash import near_duplicates


def op1_minhash_near_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_quality_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op3_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op4_warc_index(spark, sf_dir):
    index = warc.capture_history(table(spark, sf_dir, "pages"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured")


def op5_personal_data(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return pii.find_personal_data(docs, pii.fit(docs))


def op6_licence_scan(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return licences.scan(docs, licences.fit(docs))


def op7_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs))


def op8_line_dedup(spark, sf_dir):
    return lines.line_report(table(spark, sf_dir, "documents"))


def op9_decontamination(spark, sf_dir):
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_top_k_search(spark, sf_dir):
    vectors = topk.scaled(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0))


def op11_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op12_filter_audit(spark, sf_dir):
    return audit.interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_periodic_runs(spark, sf_dir):
    return repetition.periodic_runs(table(spark, sf_dir, "documents"), repetition.rewritten)


QUERIES = {f.__name__: f for f in (op1_minhash_near_dedup, op2_quality_classifier, op3_packing, op4_warc_index, op5_personal_data, op6_licence_scan, op7_language_id, op8_line_dedup, op9_decontamination, op10_top_k_search, op11_toxicity, op12_filter_audit, op13_periodic_runs)}

_TOP_K = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) as e from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id as vec_id, list_inner_product(q.e, c.e)::bigint as score
  from v q join v c on q.vec_id <> c.vec_id and len(q.e) = len(c.e) where q.vec_id % 100 = 0
), r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as place from s)
select query_id, place::int as rank, vec_id, score from r where place <= 10
"""

_WARC = """
with p as (
  select page_id, url, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages
), f as (select payload_digest, min(page_id) as first_id from p where payload_bytes >= 100 group by payload_digest),
c as (select p.*, regexp_replace(coalesce(url, ''), '[\\x00-\\x20\\x7f]', '', 'g') as u, f.first_id from p left join f using (payload_digest))
select page_id, payload_bytes::bigint as payload_bytes, payload_digest,
  case when page_id > first_id then 'revisit' else 'response' end as record_type,
  case when page_id > first_id then first_id end as refers_to,
  array_to_string(list_reverse(string_split(regexp_extract(lower(u), '^(?:[a-z][a-z0-9+.-]*://)?(?:[^/?#@]*@)?(?:www\\.)?([^/?#:]*)', 1), '.')), ',')
    || ')' || regexp_replace(u, '^(?:[A-Za-z][A-Za-z0-9+.-]*://)?[^/?#]*', '') as url_key,
  strftime(make_timestamp((1700000000 + ((coalesce(page_id, 0) % 315360000) + 315360000) % 315360000) * 1000000), '%Y-%m-%dT%H:%M:%SZ') as captured
from c
"""

_WINDOWS = """
with b as (
  select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w
  from benchmark where item_id is not null and text is not null
), d as (
  select row_number() over () as rid, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) as w
  from documents
), bw as (
  select distinct item_id, least(len(w), 10) as size, array_to_string(w[i:i + 9], ' ') as win
  from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from b where len(w) > 0)
), sizes as (select distinct size from bw),
dw as (
  select rid, i, size, array_to_string(w[i:i + size - 1], ' ') as win
  from (select rid, w, size, unnest(range(1, len(w) - size + 2)) as i from d, sizes where len(w) >= size)
), hit as (select rid, i, dw.size, item_id from dw join bw using (win) where dw.size = bw.size),
bp as (
  select item_id, i as place, least(len(w), 10) as size, array_to_string(w[i:i + 9], ' ') as win
  from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from b where len(w) > 0)
), dg as (select distinct rid, item_id, i, i - place as diag, dw.size from dw join bp using (win) where dw.size = bp.size),
dn as (select *, i - row_number() over (partition by rid, item_id, diag order by i) as run from dg),
longest as (select rid, max(n) as longest_match from (select rid, max(i + size) - min(i) as n from dn group by rid, item_id, diag, run) group by rid),
words as (select rid, count(distinct pos) as n_hit from (select rid, unnest(range(i, i + size)) as pos from hit) group by rid),
items as (select rid, count(*) as n_items, string_agg(item_id, ',' order by item_id) as names from (select distinct rid, item_id::varchar as item_id from hit) group by rid)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated,
  case when names is null then []::varchar[] else string_split(names, ',') end as items, coalesce(longest_match, 0)::bigint as longest_match
from d left join words using (rid) left join items using (rid) left join longest using (rid)
"""

ORACLES = {"op4_warc_index": _WARC, "op8_line_dedup": lines.ORACLE, "op9_decontamination": _WINDOWS, "op10_top_k_search": _TOP_K, "op12_filter_audit": audit.ORACLE}
