"""The queries op1 .. op10 over the driver's tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm import embed_dedup, html_extract, media, mixing, near_dup, packing, quality, tokens, toxicity, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = media.media_columns(table(spark, sf_dir, "documents"))
    codes = F.sha2(F.concat_ws(",", F.transform("codes", lambda c: c.cast("string"))), 256)
    times = F.crc32(F.concat_ws(",", F.transform("times", lambda t: t.cast("string"))))
    n = F.octet_length("payload").cast("long")
    return m.select(
        "doc_id", "n_bytes", n.alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(F.expr("substring(payload, -32, 32)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(":", F.size("codes").cast("string"), F.hex(times), F.substring(codes, 1, 32)).alias("feature"),
    )


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.embedding_components(table(spark, sf_dir, "embeddings"), cosine=0.93)


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), percent=85, width=5)


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mixing.mixture(table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, cap=2.0)
    return m.select("doc_id", "size", "source_size", "target", "taken")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tokens.prefix_table(table(spark, sf_dir, "documents"))
    return t.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), modulus=5, held_out=0)
    return _labelled(s, 5, 0)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), modulus=3, held_out=1)
    return _labelled(s, 3, 1)


def _labelled(s: DataFrame, modulus: int, held_out: int) -> DataFrame:
    rest = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(modulus))
    return s.select("doc_id", F.coalesce(rest == held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), window=4096, depth=3, end_id=2)


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = warc.read_archives(warc.write_archives(table(spark, sf_dir, "pages"), least_bytes=0), with_payload=False)
    return got.filter("kind = 'record'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_media_columns, op2_embedding_near_dedup, op3_minhash_near_dedup, op4_source_mixing, op5_token_counts, op6_toxicity, op7_quality_classifier, op8_packing, op9_html_extraction, op10_warc)
}

_REACH = """
, reach(a, b) as (select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a)
, least as (select a, min(b) as m from reach group by a)
"""

ORACLE_SQL: dict[str, str] = {
    "op2_embedding_near_dedup": f"""
with recursive v as (
  select vec_id, label, embedding::double[] as x from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda e: e is null or not isfinite(e))) = 0 and len(list_filter(embedding, lambda e: e <> 0)) > 0
), links as (
  select p.vec_id as a, q.vec_id as b from v p join v q on p.label = q.label and p.vec_id <> q.vec_id and len(p.x) = len(q.x) where list_cosine_similarity(p.x, q.x) >= 0.93
){_REACH}
, n as (select a, count(*) as n_links from links group by a)
select e.vec_id, coalesce(n.n_links, 0)::bigint as n_links, least(e.vec_id, coalesce(l.m, e.vec_id)) as component_id, least(e.vec_id, coalesce(l.m, e.vec_id)) = e.vec_id as kept
from embeddings e left join n on n.a = e.vec_id left join least l on l.a = e.vec_id
""",
    "op3_minhash_near_dedup": f"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as ws from documents
), s as (
  select distinct doc_id, unnest(list_transform(range(1, greatest(2, len(ws) - 3)), lambda i: array_to_string(ws[i:i + 4], ' '))) as sh from w where len(ws) > 0
), n as (select doc_id, count(*) as k from s group by doc_id)
, common as (select p.doc_id as a, q.doc_id as b, count(*) as c from s p join s q on p.sh = q.sh and p.doc_id <> q.doc_id group by 1, 2)
, links as (select a, b from common join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.k + y.k - c)){_REACH}
select d.doc_id, coalesce(n.k, 0)::bigint as n_shingles, least(d.doc_id, coalesce(l.m, d.doc_id)) as component_id, least(d.doc_id, coalesce(l.m, d.doc_id)) = d.doc_id as kept
from documents d left join n on n.doc_id = d.doc_id left join least l on l.a = d.doc_id
""",
    "op10_warc": """
with p as (select page_id, coalesce(html, '') as h from pages), q as (select page_id, strlen(h)::bigint as payload_bytes, sha1(h) as s, h from p)
, r as (select *, max(page_id) over (partition by h) as first_id from q)
select page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(s, (5 * (i // 4) + 1)::int, 5))::bigint >> (15 - 5 * (i % 4))::int) & 31)::int, 1)), '') as payload_digest,
  case when page_id = first_id then 'response' else 'revisit' end as record_type, case when page_id <> first_id then first_id end as refers_to
from r
""",
}
