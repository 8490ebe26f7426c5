"""Queries of the index, vector, fusion and confidence operators. Questions are the benchmark passages; the vectors whose
id is divisible by 50 are compared with all."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.operators import fusion, understanding, vector
from lexiloom.operators.lexical import LexicalIndex, corpus_stats, document_frequencies, postings, top_k
from lexiloom.plans import sql
from lexiloom.sources.store import staged, table

ORACLE: dict[str, str] = {}
QUERIES: dict = {}


def query(oracle: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return put


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def _items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


_P = f"with {sql.search_ctes()}"


@query(f"{_P} select doc_id, dl, term, tf from tf join dl using (doc_id)")
def postings_table(spark: SparkSession, d: str) -> DataFrame:
    return postings(_docs(spark, d))


@query(f"{_P} select term, df as doc_frequency from df")
def term_doc_freq(spark: SparkSession, d: str) -> DataFrame:
    return document_frequencies(postings(_docs(spark, d)))


@query(f"{_P} select n as total_docs, round(avgdl, 6) as avg_doc_length from st")
def corpus_statistics(spark: SparkSession, d: str) -> DataFrame:
    return corpus_stats(_docs(spark, d)).select("total_docs", F.round("avg_doc_length", 6).alias("avg_doc_length"))


@query(sql.search())
def bm25_batch_search(spark: SparkSession, d: str) -> DataFrame:
    return LexicalIndex.build(_docs(spark, d), stem=False).search(_items(spark, d), 10)


@query()
def bm25_stemmed(spark: SparkSession, d: str) -> DataFrame:
    return LexicalIndex.build(_docs(spark, d)).search(_items(spark, d), 10)


_EXPANDED = "select query_id * 2 + v as query_id, t as text from (select item_id as query_id, unnest([0, 1]) as v, unnest([text, substr(text, 1, 60)]) as t from benchmark)"


@query(f"with {sql.search_ctes(questions=_EXPANDED)}, b as (select query_id // 2 as query_id, doc_id, max(score) as score from s where score > 0 group by 1, 2) {sql.ranked('b', 10)}")
def bm25_expanded_max(spark: SparkSession, d: str) -> DataFrame:
    v = _items(spark, d).select("query_id", F.posexplode(F.array("text", F.substring("text", 1, 60))).alias("variation_id", "text"))
    return LexicalIndex.build(_docs(spark, d), stem=False).search_expanded(v, 10)


@query(sql.search("select doc_id, case when doc_id % 3 = 0 then text || ' renewed' else text end as text from documents"))
def bm25_upsert(spark: SparkSession, d: str) -> DataFrame:
    """An index of two thirds of the documents, then a third of them changed and the others added: equal to a rebuild."""
    docs = _docs(spark, d).select("doc_id", "text")
    base = LexicalIndex.build(docs.filter("doc_id % 3 <> 1"), stem=False)
    later = docs.filter("doc_id % 3 <> 2").withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit(" renewed"))).otherwise(F.col("text")))
    return base.upsert(later).search(_items(spark, d), 10)


@query(sql.search("select doc_id, text from documents where doc_id % 4 <> 3"))
def bm25_remove(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    return LexicalIndex.build(docs, stem=False).remove(docs.filter("doc_id % 4 = 3").select("doc_id")).search(_items(spark, d), 10)


def _cosine_sql(k: int, threshold: float) -> str:
    pairs = f"select q.vec_id as query_id, v.vec_id, round(list_cosine_similarity(q.x, v.x), 6) + 0.0 as score from e q join e v on q.vec_id % 50 = 0 where round(list_cosine_similarity(q.x, v.x), 6) >= {threshold}"
    return f"with e as (select vec_id, embedding::double[] as x from embeddings) {sql.ranked(f'({pairs})', k, item='vec_id')}"


def _nearest(spark: SparkSession, d: str, k: int, threshold: float) -> DataFrame:
    v = table(spark, d, "embeddings")
    return vector.nearest(v, v.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), k, threshold)


@query(_cosine_sql(10, 0.0))
def cosine_batch(spark: SparkSession, d: str) -> DataFrame:
    return _nearest(spark, d, 10, 0.0)


@query(_cosine_sql(100, 0.5))
def cosine_threshold(spark: SparkSession, d: str) -> DataFrame:
    return _nearest(spark, d, 100, 0.5)


@query()
def vector_signature(spark: SparkSession, d: str) -> DataFrame:
    return vector.signature(table(spark, d, "embeddings"))


@query("select count(embedding) as embeddings, max(len(embedding)) as dimension, round(count(embedding) * (max(len(embedding)) * 8 + 100) / 1048576, 2) as megabytes, false as is_limited from embeddings")
def vector_memory(spark: SparkSession, d: str) -> DataFrame:
    return vector.memory_estimate(table(spark, d, "embeddings"))


@query("select vec_id, label::bigint as label from embeddings order by vec_id limit 100")
def vector_limit(spark: SparkSession, d: str) -> DataFrame:
    return vector.first_vectors(table(spark, d, "embeddings"), 100).select("vec_id", "label")


@query("select doc_id from documents where doc_id not in (select vec_id from embeddings where embedding is not null)")
def missing_embeddings(spark: SparkSession, d: str) -> DataFrame:
    return vector.missing_embeddings(_docs(spark, d), table(spark, d, "embeddings")).select("doc_id")


def _lexical(spark: SparkSession, d: str) -> DataFrame:
    return staged(LexicalIndex.build(_docs(spark, d), stem=False).search(_items(spark, d), 20), "lexical-list")


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    """A question's vector is that of its id; documents and vectors share ids."""
    v = table(spark, d, "embeddings")
    q = v.join(_items(spark, d), F.col("vec_id") == F.col("query_id"), "left_semi").select(F.col("vec_id").alias("query_id"), "embedding")
    return vector.nearest(v, q, 20).select("query_id", F.col("vec_id").alias("doc_id"), "score", "rank")


_LISTS = f"""{sql.search_ctes()}, b as ({sql.ranked('(select * from s where score > 0)', 20)}),
e as (select vec_id, embedding::double[] as x from embeddings),
vp as (select q.vec_id as query_id, v.vec_id as doc_id, round(list_cosine_similarity(q.x, v.x), 6) + 0.0 as score from e q join e v on q.vec_id in (select item_id from benchmark)),
v as ({sql.ranked('(select * from vp where score >= 0)', 20)})"""


def _norm(t: str) -> str:
    return f"select query_id, doc_id, case when max(score) over w = min(score) over w then 1.0::double else (score - min(score) over w) / (max(score) over w - min(score) over w) end as score from {t} window w as (partition by query_id)"


_MERGED = f"with {_LISTS}, m as (select query_id, doc_id, round(sum(score), 6) as score from (select query_id, doc_id, score * 0.7::double as score from ({_norm('v')}) union all select query_id, doc_id, score * 0.3::double from ({_norm('b')})) group by 1, 2)"


@query(f"with {_LISTS} select query_id, doc_id, round(score, 6) as score from ({_norm('b')})")
def minmax_normalize(spark: SparkSession, d: str) -> DataFrame:
    return fusion.minmax(_lexical(spark, d)).select("query_id", "doc_id", F.round("score", 6).alias("score"))


@query(f"{_MERGED} select query_id, doc_id, score from m")
def hybrid_merge(spark: SparkSession, d: str) -> DataFrame:
    return fusion.hybrid(_vectors(spark, d), _lexical(spark, d)).select("query_id", "doc_id", F.round("score", 6).alias("score"))


@query(f"with {_LISTS}, l as (select query_id, 0 as variation_id, doc_id, score, rank from v union all select query_id, 1, doc_id, score, rank from b) select query_id, doc_id, variation_id::bigint as variation_id, score, rank from l qualify row_number() over (partition by query_id, doc_id order by variation_id, rank) = 1")
def dedupe_first_wins(spark: SparkSession, d: str) -> DataFrame:
    lists = _vectors(spark, d).withColumn("variation_id", F.lit(0)).unionByName(_lexical(spark, d).withColumn("variation_id", F.lit(1)))
    return fusion.first_wins(lists).select("query_id", "doc_id", "variation_id", "score", "rank")


_HEAD = "lang || ' > ' || source"


def _boost(t: str) -> str:
    return f"select {t}.query_id, {t}.doc_id, round(case when len(list_filter({sql.general('i.text')}, lambda w: contains(lower({_HEAD}), w))) > 0 then score * 1.3 else score end, 6) as score from {t} join benchmark i on i.item_id = {t}.query_id left join documents o on o.doc_id = {t}.doc_id"


def _headings(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.concat_ws(" > ", "lang", "source").alias("heading_path"))


@query(f"with {_LISTS}, h as ({_boost('b').replace('i.text', chr(39) + 'src1 fr and' + chr(39))}) {sql.ranked('h', 1000)}")
def heading_rerank(spark: SparkSession, d: str) -> DataFrame:
    asked = _items(spark, d).withColumn("text", F.lit("src1 fr and"))
    return fusion.heading_rerank(_lexical(spark, d), asked, _headings(spark, d))


@query(f"with {_LISTS} select b.query_id, b.doc_id, round(b.score * case when l.doc_id is null then 1 else 1.2 end, 6) as score from b left join (select distinct doc_id from documents where source in ('src1', 'src2')) l on l.doc_id = b.doc_id")
def graph_boost(spark: SparkSession, d: str) -> DataFrame:
    """Sources stand for entities; each question names two of them."""
    entities = _docs(spark, d).select("source").distinct().select(F.col("source").alias("entity_id"), F.lower("source").alias("normalized_name"))
    links = _docs(spark, d).select("doc_id", F.col("source").alias("entity_id"))
    asked = _items(spark, d).withColumn("text", F.lit("src1 or src2?"))
    return fusion.boosted(_lexical(spark, d), fusion.graph_boosts(asked, entities, links), ["query_id", "doc_id"]).select("query_id", "doc_id", F.round("score", 6).alias("score"))


def _diverse(t: str) -> str:
    inner = f"select {t}.query_id, {t}.doc_id, source as page, score from {t} left join documents o on o.doc_id = {t}.doc_id qualify row_number() over (partition by query_id, source order by score desc, {t}.doc_id) <= 2"
    return sql.ranked(f"({inner})", 5, extra="page,")


@query(f"with {_LISTS} {_diverse('b')}")
def diversify(spark: SparkSession, d: str) -> DataFrame:
    return fusion.diversify(_lexical(spark, d), _docs(spark, d).select("doc_id", F.col("source").alias("page")))


def _retrieved(spark: SparkSession, d: str) -> DataFrame:
    """The whole retrieval: hybrid lists, heading boost, at most two of a source, five in all."""
    merged = top_k(fusion.hybrid(_vectors(spark, d), _lexical(spark, d)), ["query_id"], 1000).select("query_id", "doc_id", "score")
    boosted = fusion.heading_rerank(merged, _items(spark, d), _headings(spark, d))
    return fusion.diversify(boosted, _docs(spark, d).select("doc_id", F.col("source").alias("page")))


_RETRIEVED = f"{_MERGED}, h as ({_boost('m')}), r as ({_diverse('h')})"


@query(f"{_RETRIEVED} select * from r")
def retrieve_pipeline(spark: SparkSession, d: str) -> DataFrame:
    return _retrieved(spark, d)


@query(f"""{_RETRIEVED},
c as (select r.query_id, max(score) as m, avg(score) as a, string_agg(o.text, ' ' order by rank) as content from r join documents o using (doc_id) group by 1),
f as (select i.item_id as query_id, coalesce(greatest(0, least(1, 0.6::double * m + 0.4::double * a)), 0) as retrieval,
  case when content is null or len(w) = 0 then 0 else len(list_filter(w, lambda x: contains(lower(content), x))) / len(w) end as coverage
  from (select *, {sql.general('text')} as w from benchmark) i left join c on c.query_id = i.item_id),
g as (select *, greatest(0, least(1, 0.6::double * retrieval + 0.4::double * coverage)) as overall from f)
select query_id, round(retrieval, 6) as retrieval, round(coverage, 6) as coverage, round(overall, 6) as overall, case when overall >= 0.8 then 'high' when overall >= 0.5 then 'medium' else 'low' end as level, overall >= 0.5 as answerable from g""")
def retrieval_confidence(spark: SparkSession, d: str) -> DataFrame:
    got = _retrieved(spark, d).join(_docs(spark, d).select("doc_id", F.col("text").alias("content")), "doc_id")
    return understanding.confidence(_items(spark, d), got)


@query(f"""with {_LISTS}, p as (select query_id, rank, '[' || {_HEAD} || ']' || chr(10) || 'Source: ' || source || chr(10) || text as piece from b join documents using (doc_id)),
o as (select *, coalesce(sum(length(piece)) over (partition by query_id order by rank rows between unbounded preceding and 1 preceding), 0) as before from p),
u as (select *, max((before + length(piece) > 4000)::int) over (partition by query_id order by rank rows between unbounded preceding and 1 preceding) as stopped from o)
select query_id, string_agg(case when before + length(piece) <= 4000 then piece else substr(piece, 1, (4000 - before)::int) || '...' end, chr(10) || chr(10) || '---' || chr(10) || chr(10) order by rank) as context
from u where coalesce(stopped, 0) = 0 and (before + length(piece) <= 4000 or 4000 - before > 100) group by 1""")
def build_context(spark: SparkSession, d: str) -> DataFrame:
    rows = _lexical(spark, d).join(_docs(spark, d).select("doc_id", "text", "lang", "source"), "doc_id")
    piece = understanding.formatted_chunk(F.col("text"), F.concat_ws(" > ", "lang", "source"), F.col("source"))
    return understanding.build_context(rows.select("query_id", "rank", piece.alias("piece")))


@query(f"with {_LISTS}, o as (select query_id, source, min(rank) as r from b join documents using (doc_id) group by 1, 2) select query_id, source, row_number() over (partition by query_id order by r) as position from o")
def source_list(spark: SparkSession, d: str) -> DataFrame:
    rows = _lexical(spark, d).join(_docs(spark, d).select("doc_id", F.col("source").alias("page_url")), "doc_id")
    return understanding.source_list(rows)


@query("""
with e as (select vec_id, embedding[1:3]::double[] as v, [vec_id % 3, 1.0, 2.0 - vec_id % 3]::double[] as w from embeddings)
select vec_id, round(case when vec_id % 7 = 0 or w[1] + w[2] + w[3] = 0 then 0 else (v[1] * w[1] + v[2] * w[2] + v[3] * w[3]) / (w[1] + w[2] + w[3]) end, 6) + 0.0 as average from e""")
def weighted_averages(spark: SparkSession, d: str) -> DataFrame:
    v = F.when(F.col("vec_id") % 7 == 0, F.array().cast("array<double>")).otherwise(F.slice(F.col("embedding").cast("array<double>"), 1, 3))
    third = F.col("vec_id") % 3
    w = F.array(third.cast("double"), F.lit(1.0), (2 - third).cast("double"))
    return table(spark, d, "embeddings").select("vec_id", (F.round(understanding.weighted_average(v, w), 6) + 0.0).alias("average"))
