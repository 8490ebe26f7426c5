"""Queries of the graph, crawl, log and integrity operators, and of the streams. Regions, nations, suppliers, customers
and parts stand for entities; their keys for edges; orders for documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.functions.text import general_tokens
from lexiloom.operators import analytics, crawl, extraction, graph, understanding
from lexiloom.plans import sql
from lexiloom.plans.text_queries import _chain
from lexiloom.sources.store import Bucketed, _file_system, shared_dir, staging_path, table
from lexiloom.streaming import streams

ORACLE: dict[str, str] = {}
QUERIES: dict = {}


def query(oracle: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return put


_ENTITIES = """
e as (select n_nationkey * 10 + 1 as entity_id, n_name as name, 'nation' as type, lower(trim(n_name)) as normalized_name from nation
  union all select r_regionkey * 10, r_name, 'region', lower(trim(r_name)) from region
  union all select c_custkey * 10 + 2, c_name, 'customer', lower(trim(c_name)) from customer
  union all select s_suppkey * 10 + 3, s_name, 'supplier', lower(trim(s_name)) from supplier),
g as (select n_nationkey * 10 + 1 as source_id, n_regionkey * 10 as target_id, 'in' as type from nation
  union all select c_custkey * 10 + 2, c_nationkey * 10 + 1, 'lives' from customer
  union all select s_suppkey * 10 + 3, s_nationkey * 10 + 1, 'sells' from supplier)"""


def _entities(spark: SparkSession, d: str) -> DataFrame:
    kind = lambda t, k, n, i: table(spark, d, t).select((F.col(k).cast("long") * 10 + i).alias("entity_id"), F.col(n).alias("name"), F.lit(t).alias("type"), F.lit("").alias("description"))
    rows = kind("nation", "n_nationkey", "n_name", 1).unionByName(kind("region", "r_regionkey", "r_name", 0)).unionByName(kind("customer", "c_custkey", "c_name", 2)).unionByName(kind("supplier", "s_suppkey", "s_name", 3))
    return rows.withColumn("normalized_name", graph.normalize_name(F.col("name")))


def _edges(spark: SparkSession, d: str) -> DataFrame:
    edge = lambda t, a, i, b, j, kind: table(spark, d, t).select((F.col(a).cast("long") * 10 + i).alias("source_id"), (F.col(b).cast("long") * 10 + j).alias("target_id"), F.lit(kind).alias("type"), F.lit("").alias("description"))
    return edge("nation", "n_nationkey", 1, "n_regionkey", 0, "in").unionByName(edge("customer", "c_custkey", 2, "c_nationkey", 1, "lives")).unionByName(edge("supplier", "s_suppkey", 3, "s_nationkey", 1, "sells"))


@query("""
with m as (select p_name as name, p_type as type, p_brand as description, p_partkey as ord from part union all select upper(p_name) || ' ', p_type, p_brand, p_partkey + 10000000 from part),
f as (select lower(trim(name)) as normalized_name, arg_min(name, ord) as name, arg_min(type, ord) as type, arg_min(description, ord) as description, min(ord) as ord from m where name <> '' and type <> '' group by 1)
select row_number() over (order by ord) - 1 as entity_id, name, type, description, normalized_name from f
""")
def entity_resolve(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_name").alias("name"), F.col("p_type").alias("type"), F.col("p_brand").alias("description"), F.col("p_partkey").cast("long").alias("ord"))
    loud = p.withColumn("name", F.concat(F.upper("name"), F.lit(" "))).withColumn("ord", F.col("ord") + 10_000_000)
    return graph.resolve_entities(p.unionByName(loud))


@query(f"with {_ENTITIES} select distinct o_orderkey as doc_id, e.entity_id from orders join customer on c_custkey = o_custkey join e on e.normalized_name = lower(trim(c_name))")
def entity_links(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("doc_id"), F.col("c_name").alias("name"))
    return graph.link_entities(m, _entities(spark, d))


@query(f"with {_ENTITIES} select distinct s.entity_id as source_id, t.entity_id as target_id, 'from' as type, '' as description from orders join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey join e s on s.normalized_name = lower(c_name) join e t on t.normalized_name = lower(n_name)")
def relationship_resolve(spark: SparkSession, d: str) -> DataFrame:
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    found = table(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    found = found.select(F.upper("c_name").alias("source"), F.col("n_name").alias("target"), F.lit("from").alias("type"), F.lit("").alias("description"), F.col("o_orderkey").alias("ord"))
    return graph.resolve_relationships(found, _entities(spark, d))


@query(f"with {_ENTITIES}, n as (select source_id as entity_id, target_id as other_id, type, 'outgoing' as direction from g union all select target_id, source_id, type, 'incoming' from g) select n.entity_id, other_id, name as other_name, n.type, direction from n join e on e.entity_id = other_id")
def neighbours(spark: SparkSession, d: str) -> DataFrame:
    return graph.neighbours(_edges(spark, d), _entities(spark, d)).select("entity_id", "other_id", "other_name", "type", "direction")


@query(f"""with {_ENTITIES}, n as (select source_id as entity_id, target_id as other_id, type, 'outgoing' as direction from g union all select target_id, source_id, type, 'incoming' from g),
l as (select n.entity_id, direction, n.type, other_id, name as other_name from n join e on e.entity_id = other_id)
select e.entity_id, e.name, direction, l.type, other_id, other_name from e left join l on l.entity_id = e.entity_id""")
def subgraph(spark: SparkSession, d: str) -> DataFrame:
    return graph.subgraph(_entities(spark, d), _edges(spark, d))


@query(f"with {_ENTITIES}, p as (select source_id as from_id, target_id as to_id, type, 'forward' as direction from g where type <> 'sells' union all select target_id, source_id, type, 'reverse' from g where type = 'sells') select from_id, to_id, min(type) as type, min(direction) as direction from p group by 1, 2")
def direct_paths(spark: SparkSession, d: str) -> DataFrame:
    e = _edges(spark, d)
    turned = F.col("type") == "sells"
    pairs = e.select(F.when(turned, F.col("target_id")).otherwise(F.col("source_id")).alias("from_id"), F.when(turned, F.col("source_id")).otherwise(F.col("target_id")).alias("to_id")).distinct()
    return graph.direct_paths(pairs, e)


@query("select p_partkey as entity_id, p_name as name from part where contains(lower(p_name || chr(10) || p_type), 'red') or contains(lower(p_name || chr(10) || p_type), 'gear')")
def entity_search(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("name"), F.col("p_type").alias("description"))
    return graph.search_entities(parts, F.lit("Red gear?")).select("entity_id", "name")


@query(f"with {_ENTITIES} select source_id, s.name as source_name, target_id::bigint as target_id, t.name as target_name, g.type from g join e s on s.entity_id = source_id join e t on t.entity_id = target_id")
def export_graph(spark: SparkSession, d: str) -> DataFrame:
    return graph.export_edges(_edges(spark, d), _entities(spark, d)).drop("json")


@query("""
with recursive l as (select 'r' || n_regionkey as src, 'n' || n_nationkey as dst from nation union all select 'n' || c_nationkey, 'c' || c_custkey from customer union all select 'c' || o_custkey, 'o' || o_orderkey from orders union all select 'o' || o_orderkey, 'c' || o_custkey from orders),
b as (select 'r0' as node, 0::bigint as depth union select dst, depth + 1 from b join l on l.src = b.node where depth < 4)
select node, min(depth) as depth from b group by 1
""")
def crawl_bfs(spark: SparkSession, d: str) -> DataFrame:
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    n, c, o = (table(spark, d, t) for t in ("nation", "customer", "orders"))
    links = n.select(key("r", "n_regionkey").alias("src"), key("n", "n_nationkey").alias("dst")).union(c.select(key("n", "c_nationkey"), key("c", "c_custkey")))
    links = links.union(o.select(key("c", "o_custkey"), key("o", "o_orderkey"))).union(o.select(key("o", "o_orderkey"), key("c", "o_custkey")))
    return crawl.bfs(links, spark.createDataFrame([("r0",)], "node string"))


@query("select session_id, id, position from (select user_id as session_id, event_id as id, row_number() over (partition by user_id order by ts, event_id) as position from events) where position <= 3")
def frontier_fifo(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("id"), F.col("ts").alias("added_at"))
    return crawl.fifo(q, 3).select("session_id", "id", "position")


def _log(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    return table(spark, d, "events").select(
        F.col("event_id").alias("id"), F.col("ts").alias("timestamp"), F.col("event_type").alias("query_type"), (v > 10).alias("answer_generated"), F.least(F.lit(1.0), v / 100).alias("confidence_score"),
        analytics.to_ms(v / 1000).alias("total_time_ms"), analytics.to_ms(v / 4000).alias("search_time_ms"),
    )


_L = "l as (select event_id as id, ts as timestamp, event_type as query_type, value > 10 as answer_generated, least(1.0::double, value / 100) as confidence_score, nullif(value / 1000, 0) * 1000 as total_time_ms, nullif(value / 4000, 0) * 1000 as search_time_ms from events)"


@query(f"with {_L} select count(*) as total_queries, count_if(answer_generated)::bigint as answers_generated, coalesce(round(avg(confidence_score), 4), 0) as avg_confidence, nullif(round(avg(total_time_ms), 2), 0) as avg_total_time_ms, nullif(round(avg(case when total_time_ms is not null then search_time_ms end), 2), 0) as avg_search_time_ms from l")
def query_analytics(spark: SparkSession, d: str) -> DataFrame:
    return analytics.query_analytics(_log(spark, d))


@query(f"with {_L} select query_type, count(*) as n from l group by 1")
def query_type_counts(spark: SparkSession, d: str) -> DataFrame:
    return analytics.type_counts(_log(spark, d))


@query(f"with {_L} select id, query_type, round(confidence_score, 6) as confidence_score from l order by timestamp desc, id desc limit 100")
def recent_logs(spark: SparkSession, d: str) -> DataFrame:
    return analytics.recent(_log(spark, d)).select("id", "query_type", F.round("confidence_score", 6).alias("confidence_score"))


@query("select event_type as metric, count(value) as n, min(value) as least, max(value) as most, round(avg(value), 6) as mean, round(sum(value), 4) as total from events group by 1")
def metric_aggregates(spark: SparkSession, d: str) -> DataFrame:
    return analytics.metric_aggregates(table(spark, d, "events").select(F.col("event_type").alias("metric"), "value"))


@query(f"with {_L} select strftime(date_trunc('day', timestamp), '%Y-%m-%d') as day, query_type, count(*) as n from l group by 1, 2")
def windowed_log(spark: SparkSession, d: str) -> DataFrame:
    return analytics.windowed_counts(_log(spark, d)).select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "query_type", "n")


@query(f"with {_ENTITIES} select (select count(*) from pages) as pages, (select count(*) from documents) as chunks, (select count(embedding) from embeddings) as embedded, (select count(*) from e) as entities")
def corpus_counts(spark: SparkSession, d: str) -> DataFrame:
    t = lambda n: table(spark, d, n)
    return analytics.corpus_counts(t("pages"), t("documents"), t("embeddings"), _entities(spark, d))


@query("""
select 'lines without order' as issue, count(*) as n from lineitem where l_orderkey not in (select o_orderkey from orders)
union all select 'orders without customer', count(*) from orders where o_custkey not in (select c_custkey from customer)
union all select 'documents without label', count(*) from documents where doc_id not in (select doc_id from labels)
union all select 'documents without embedding', count(*) from documents where doc_id not in (select vec_id from embeddings)
""")
def validate_integrity(spark: SparkSession, d: str) -> DataFrame:
    t = lambda n: table(spark, d, n)
    return analytics.integrity([
        ("lines without order", analytics.orphans(t("lineitem"), t("orders"), "l_orderkey", "o_orderkey")),
        ("orders without customer", analytics.orphans(t("orders"), t("customer"), "o_custkey", "c_custkey")),
        ("documents without label", analytics.orphans(t("documents"), t("labels"), "doc_id", "doc_id")),
        ("documents without embedding", analytics.orphans(t("documents"), t("embeddings"), "doc_id", "vec_id")),
    ])


def _stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table as a stream of files; a table that is one file is found by its name in its folder."""
    path = f"{d}/{name}.parquet"
    reader = spark.readStream.schema(table(spark, d, name).schema)
    p, fs = _file_system(spark, path)
    return reader.parquet(path) if fs.getFileStatus(p).isDirectory() else reader.option("pathGlobFilter", f"{name}.parquet").parquet(d)


def _events_stream(spark: SparkSession, d: str) -> DataFrame:
    return _stream(spark, d, "events").select(F.col("ts").alias("timestamp"), F.col("event_type").alias("query_type"))


@query("select event_type as query_type, count(*) as n from events group by 1")
def stream_query_log(spark: SparkSession, d: str) -> DataFrame:
    import uuid

    name = f"log_{uuid.uuid4().hex}"
    return streams.running_type_counts(_events_stream(spark, d), name, f"{shared_dir(spark).rstrip('/')}/{name}")


@query(f"""
with t as (select distinct unnest({sql.general('text')}) as name from benchmark), k as (select name from t where length(name) >= 8),
w as (select distinct doc_id as page_id, unnest({sql.general('substr(text, 1, 5000)')}) as name from documents)
select page_id, name, 'word' as type from w join k using (name)""")
def entity_extract(spark: SparkSession, d: str) -> DataFrame:
    """A dictionary of the longer words of the benchmark passages, found in the documents."""
    words = table(spark, d, "benchmark").select(F.explode(general_tokens(F.col("text"))).alias("name")).distinct().filter(F.length("name") >= 8)
    find = extraction.dictionary_extractor(words.select("name", F.lit("word").alias("type"), F.lit("").alias("description")))
    return find(table(spark, d, "documents").select(F.col("doc_id").alias("page_id"), "text"))[0].select("page_id", "name", "type")


@query(f"select page_id, url, sha256({_chain('html')}) as content_hash from pages qualify row_number() over (partition by url order by page_id desc) = 1")
def stream_index(spark: SparkSession, d: str) -> DataFrame:
    """Pages as a stream into the index, read back; the newest page of each url is stored."""
    root = staging_path(spark, "stream-index")
    streams.index_pages(_stream(spark, d, "pages"), root, f"{root}-checkpoint")
    return Bucketed(spark, f"{root}/pages", "url").read().select("page_id", "url", "content_hash")


@query("""
with r as (select item_id as query_id, unnest(range(1, 4)) as rank, item_id + unnest(range(1, 4)) as doc_id from benchmark)
select r.query_id, r.rank::bigint as rank, r.doc_id, d.text as content, d.lang as heading_path, p.url as page_url from r left join documents d using (doc_id) left join pages p on p.page_id = d.doc_id // 4""")
def enrich(spark: SparkSession, d: str) -> DataFrame:
    """Results with what their chunks and pages hold; ids beyond the tables pass with nulls."""
    found = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(F.array(*[F.lit(i) for i in (1, 2, 3)])).alias("rank")).withColumn("doc_id", F.col("query_id") + F.col("rank"))
    parts = table(spark, d, "documents").select("doc_id", F.floor(F.col("doc_id") / 4).alias("page_id"), F.col("text").alias("content"), F.col("lang").alias("heading_path"))
    out = understanding.enrich(found, parts, table(spark, d, "pages").select("page_id", F.lit("").alias("title"), "url"))
    return out.select("query_id", "rank", "doc_id", "content", "heading_path", "page_url")


@query(f"""with {_ENTITIES}, s as (select c_custkey as query_id, c_custkey * 10 + 2 as entity_id, 1 as first from customer union all select c_custkey, c_nationkey * 10 + 1, 2 from customer),
l as (select query_id, string_agg('- ' || name || ' (' || e.type || ')', chr(10) order by first) as entity_lines from s join e using (entity_id) group by 1),
r as (select a.query_id, string_agg('- ' || x.name || ' ' || g.type || ' ' || y.name, chr(10) order by g.source_id, g.target_id, g.type) as relation_lines
  from g join s a on a.entity_id = g.source_id join s b on b.entity_id = g.target_id and b.query_id = a.query_id join e x on x.entity_id = g.source_id join e y on y.entity_id = g.target_id group by 1)
select query_id, entity_lines, coalesce(relation_lines, '') as relation_lines from l left join r using (query_id)""")
def entity_context(spark: SparkSession, d: str) -> DataFrame:
    """Each customer as a question that found a document of the customer, then one of the nation."""
    c = table(spark, d, "customer")
    found = c.select(F.col("c_custkey").alias("query_id"), (F.col("c_custkey") * 10 + 2).alias("doc_id"), F.lit(1).alias("rank"))
    found = found.unionByName(c.select(F.col("c_custkey").alias("query_id"), (F.col("c_nationkey") * 10 + 1).alias("doc_id"), F.lit(2).alias("rank")))
    e = _entities(spark, d)
    return graph.entity_context(found, e.select(F.col("entity_id").alias("doc_id"), "entity_id"), e, _edges(spark, d))
