"""The queries of this subpackage: each operator over its whole table, and SQL for those that have one."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, langid, licenses, linededup, minhash, mixing, tokens, topk, urlfilter
from .common import table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_topk(table(spark, sf_dir, "embeddings"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.Mix(table(spark, sf_dir, "documents"))
    return mix.drawn().select("doc_id", "size", "source", "source_size", "target", "taken", "n_draws", "first_shard")


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.url_filter(table(spark, sf_dir, "pages"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(~langid.held_out()))
    return langid.predict(docs, model, langid.held_out().alias("held_out")).select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", "lang_pred", "score", "rejected")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_exact_topk, op3_source_mixing, op4_chat_formatting, op5_decontamination, op6_token_counts, op7_url_filter, op8_language_id, op9_line_dedup, op10_minhash, pipeline)}

ORACLE_SQL = {
    "op2_exact_topk": """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as e from embeddings
  where embedding is not null and vec_id is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) as bigint) as score
  from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id and len(q.e) = len(c.e)
), r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as "rank" from s)
select query_id, "rank", vec_id, score from r where "rank" <= 5
""",
    "op5_decontamination": r"""
with d as (
  select row_number() over () as rid, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from documents
), b as (
  select cast(item_id as varchar) as item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from benchmark
), bw as (
  select distinct item_id, w[s + 1:s + least(10, len(w))] as win from (select item_id, w, unnest(range(0, greatest(len(w) - 10, 0) + 1)) as s from b where len(w) > 0)
), sizes as (select distinct len(win) as k from bw), dw as (
  select rid, k, s, w[s + 1:s + k] as win from (select rid, w, k, unnest(range(0, len(w) - k + 1)) as s from d, sizes where len(w) >= k)
), h as (select rid, s, k, item_id from dw join bw using (win)), hit as (
  select rid, count(distinct p) as n_hit from (select rid, unnest(range(s, s + k)) as p from h) group by rid
), it as (select rid, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids from (select distinct rid, item_id from h where item_id is not null) group by rid)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hit using (rid) left join it using (rid)
""",
    "op7_url_filter": r"""
with u as (
  select page_id, case when url like '%://%' then substr(url, strpos(url, '://') + 3) else '' end as r from pages
), p as (
  select page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) as path from u
), rules(h, q, v) as (values ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), m as (
  select page_id, host, path, h || q as rule, v, row_number() over (partition by p.page_id, host, path order by length(h || q) desc nulls last) as n
  from p left join rules on (host = h or host like '%.' || h) and starts_with(path, q)
)
select page_id, host, path, rule, coalesce(v, 'allow') as verdict from m where n = 1
""",
    "op10_minhash": r"""
with recursive d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
), sh as materialized (
  select distinct doc_id, array_to_string(w[i + 1:i + least(3, len(w))], ' ') as g from (select doc_id, w, unnest(range(0, greatest(len(w) - 3, 0) + 1)) as i from d where len(w) > 0)
), n as materialized (select doc_id, count(*) as n from sh group by 1), c as (
  select a.doc_id as x, b.doc_id as y, count(*) as c from sh a join sh b using (g) where a.doc_id < b.doc_id group by 1, 2
), l as materialized (
  select x, y from c join n a on a.doc_id = x join n b on b.doc_id = y where 100 * c >= 85 * (a.n + b.n - c)
), e as materialized (select x, y from l union select y, x from l), reach as (
  select x as a, x as b from e union select r.a, e.y from reach r join e on e.x = r.b
), k as (select a, min(b) as m from reach group by a)
select d.doc_id, coalesce(n, 0) as n_shingles, coalesce(m, d.doc_id) as component_id, coalesce(m, d.doc_id) = d.doc_id as kept
from d left join n on n.doc_id = d.doc_id left join k on k.a = d.doc_id
""",
    "op4_chat_formatting": r"""
select conv_id, turn, role, coalesce(turn, -4611686018427387904) as anchor, cast(0 as integer) as "level", cast(0 as integer) as step,
  cast(0 as bigint) as n_calls, cast(0 as bigint) as n_linked, cast(0 as bigint) as n_invalid, cast(null as varchar) as status,
  '{' || concat_ws(',', '"content":' || cast(to_json(text) as varchar), '"role":' || cast(to_json(role) as varchar)) || '}' as "json"
from conversations
""",
}
