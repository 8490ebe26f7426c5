"""The library behind one object: tables of an index under a folder, ingest, search, answers, jobs and checks.

``Engine(spark, root)`` needs nothing else; an embedder and a chat client are injected. Everything that grows with the
corpus stays in DataFrames: a call hands on plans or writes tables, and collects what it shows only (a question's few
results, counts, single rows).

Tables: pages and chunks (in buckets of the url), postings, embeddings, entities, relationships, chunk_entities, the query
log, summaries, crawl sessions and embedding jobs.
"""

from __future__ import annotations

import datetime
import hashlib
import time
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexiloom.functions import urls
from lexiloom.functions.html import extract_links
from lexiloom.operators import analytics, answers, crawl, extraction, fusion, graph, rollup, understanding, vector
from lexiloom.operators.lexical import LexicalIndex, top_k
from lexiloom.runtime import METRICS, AnswerCache, Health, Timer
from lexiloom.settings import Settings, problems
from lexiloom.sources.http import Http, basic_token, fetched
from lexiloom.sources.sessions import CrawlSessions, EmbeddingJobs
from lexiloom.sources.store import Bucketed, Versioned, export_graph_json, export_log_csv, staged
from lexiloom.streaming.streams import index_batch

ENTITY = "entity_id long, name string, type string, description string, normalized_name string"
EDGE = "source_id long, target_id long, type string, description string"
LINK = "doc_id long, entity_id long"
LOG = (
    "id string, timestamp timestamp, query string, query_type string, expanded_queries array<string>, retrieved_chunk_ids array<long>, confidence_score double, "
    "answer_generated boolean, total_time_ms double, embedding_time_ms double, search_time_ms double, rerank_time_ms double, generation_time_ms double"
)
VECTOR = "vec_id long, embedding array<float>"
CHUNK = "doc_id long, page_id long, chunk_type string, heading_path string, content string, page_title string, page_url string"


class Engine:
    def __init__(self, spark: SparkSession, root: str, embedder=None, chat=None, settings: Settings | None = None, http: Http | None = None):
        self.spark, self.root = spark, root.rstrip("/")
        self.embedder, self.chat = embedder, chat
        self.settings = settings or Settings.from_env()
        wrong = problems(self.settings)
        if wrong:
            raise ValueError("; ".join(wrong))
        self.http = http or Http(tries=self.settings.crawler_max_retries + 1, delay=self.settings.crawler_retry_delay)
        if self.settings.basic_auth_enabled:
            token = self.settings.basic_auth_token or basic_token(self.settings.basic_auth_username, self.settings.basic_auth_password)
            self.http.headers["Authorization"] = f"Basic {token}"
        self.cache = AnswerCache(self.settings.query_cache_size, self.settings.query_cache_ttl)
        self.sessions, self.jobs = CrawlSessions(spark, f"{self.root}/crawl"), EmbeddingJobs(spark, f"{self.root}/jobs")

    # -- tables

    def _table(self, name: str, schema: str) -> DataFrame:
        got = Versioned(self.spark, f"{self.root}/{name}").read()
        return self.spark.createDataFrame([], StructType.fromDDL(schema)) if got is None else got

    def _replace(self, name: str, df: DataFrame) -> None:
        Versioned(self.spark, f"{self.root}/{name}").write(staged(df, name))

    @property
    def pages(self) -> DataFrame:
        got = Bucketed(self.spark, f"{self.root}/pages", "url").read()
        return self.spark.createDataFrame([], "page_id long, url string, content_hash string, title string, parsed_text string") if got is None else got

    @property
    def chunks(self) -> DataFrame:
        """doc_id (a hash of page and place), page_id, chunk_type, heading_path, content, page_title, page_url."""
        got = Bucketed(self.spark, f"{self.root}/chunks", "url").read()
        if got is None:
            return self.spark.createDataFrame([], CHUNK)
        titles = self.pages.select("page_id", F.col("title").alias("page_title"))
        key = F.xxhash64("page_id", "chunk_key").bitwiseAND((1 << 53) - 1)
        return got.withColumn("doc_id", key).join(titles, "page_id", "left").select("doc_id", "page_id", "chunk_type", "heading_path", "content", "page_title", F.col("url").alias("page_url"))

    @property
    def searched(self) -> DataFrame:
        """What search works on: the small chunks."""
        return self.chunks.filter("chunk_type = 'small'")

    @property
    def vectors(self) -> DataFrame:
        return self._table("embeddings", VECTOR)

    @property
    def entities(self) -> DataFrame:
        return self._table("entities", ENTITY)

    @property
    def edges(self) -> DataFrame:
        return self._table("relationships", EDGE)

    @property
    def links(self) -> DataFrame:
        return self._table("chunk_entities", LINK)

    @property
    def log(self) -> DataFrame:
        return self._table("query_log", LOG)

    # -- ingest

    def ingest(self, pages: DataFrame) -> dict[str, int]:
        """Merges raw pages (page_id, url, html) into the index; how many were new, changed and same."""
        counts = index_batch(pages, self.root)
        if counts["new"] or counts["changed"]:
            self.rebuild_index()
            if self.embedder is not None:
                self.backfill()
            self.cache.clear()
        return counts

    def rebuild_index(self) -> int:
        """Indexes all small chunks anew; how many."""
        LexicalIndex.build(self.searched, text="content").save(f"{self.root}/postings")
        return self.searched.count()

    def index(self) -> LexicalIndex:
        return LexicalIndex.load(self.spark, f"{self.root}/postings")

    def crawl(self, start_url: str, max_pages: int | None = None, ignore_robots: bool = False, fresh: bool = False, at_once: int = 16, included: list[str] | None = None) -> dict[str, Any]:
        """Fetches a site breadth first and ingests it; goes on with a session that was interrupted.

        Urls wait in the session's queue; each step takes some, fetches them inside the partitions, and adds the links that
        may be followed. An interrupt leaves the session to be resumed.
        """
        most = max_pages or self.settings.max_pages
        error = self.spark.createDataFrame([(start_url,)], "url string").select(urls.url_error(F.col("url"))).first()[0]
        if error:
            raise ValueError(f"{start_url}: {error}")
        host = start_url.split("/")[2]
        robots, delay = None, self.settings.crawl_delay_seconds
        if not ignore_robots:
            try:
                robots = urls.robots_rules(self.http.get(f"{start_url.split('/')[0]}//{host}/robots.txt")[1])
                delay = max(delay, robots.get("delay") or 0.0)
            except (RuntimeError, OSError):
                robots = None
        session = self.sessions.open(start_url, fresh)
        done = {"crawled": 0, "failed": 0, "skipped": 0, "new": 0, "changed": 0, "same": 0}
        try:
            while done["crawled"] < most:
                todo = self.sessions.take(session, min(at_once, most - done["crawled"]))
                if not todo:
                    break
                got = staged(fetched(self.spark.createDataFrame([(u,) for u in todo], "url string"), self.http, delay), "fetched")
                fine = got.filter("outcome = 'success'")
                counts = self._ingest_fetched(fine)
                crawled = fine.count()
                found = fine.select(F.explode(extract_links(F.col("html"), F.col("url"))).alias("url")).distinct()
                wanted = crawl.crawlable(found, "url", [host], list(self.settings.excluded_paths), included, robots)
                skipped = found.count() - wanted.count()
                self.sessions.enqueue(session, wanted)
                self.sessions.record(session, crawled, len(todo) - crawled, skipped)
                for k, n in (("crawled", crawled), ("failed", len(todo) - crawled), ("skipped", skipped), *counts.items()):
                    done[k] += n
            self.sessions.record(session, status="completed")
        except BaseException:
            self.sessions.record(session, status="interrupted")
            raise
        finally:
            if done["new"] or done["changed"]:
                self.rebuild_index()
                self.cache.clear()
        return {"session_id": session, **done}

    def _ingest_fetched(self, got: DataFrame) -> dict[str, int]:
        return index_batch(got.select(F.xxhash64("url").bitwiseAND((1 << 53) - 1).alias("page_id"), "url", "html"), self.root)

    def backfill(self, force: bool = False, page_id: int | None = None) -> dict[str, Any]:
        """Embeds the chunks without a vector, or all; counts. Batches that fail stay without one and are taken up next time."""
        if self.embedder is None:
            raise ValueError("embedding needs an embedder")
        have = self.vectors
        todo = self.chunks if page_id is None else self.chunks.filter(F.col("page_id") == page_id)
        todo = todo.withColumnRenamed("page_title", "title")
        rows = todo if force else vector.missing_embeddings(todo, have)
        job = self.jobs.start(rows.count(), page_id)
        text = vector.contextual_text(F.col("content"), F.col("heading_path"), F.col("title"))
        made = staged(vector.embed(rows.select("doc_id", text.alias("text")), self.embedder, "doc_id", "text", self.settings.embedding_batch_size, self.settings.embedding_batch_delay, "skip"), "embedded")
        counts = vector.embedding_counts(made).first().asDict()
        new = made.filter("embedding is not null").select(F.col("id").alias("vec_id"), "embedding")
        self._replace("embeddings", have.join(new.select("vec_id"), "vec_id", "left_anti").unionByName(new))
        self.jobs.update(job, counts["embedded"], counts["failed"], "completed" if not counts["failed"] else "interrupted")
        return {"job_id": job, **counts}

    def resume_embeddings(self, page_id: int | None = None) -> dict[str, Any]:
        return self.backfill(False, page_id)

    # -- search and answers

    def search(self, questions: DataFrame, k: int | None = None) -> DataFrame:
        """query_id, doc_id, score, rank of (query_id, text): BM25 over the stored index."""
        return self.index().search(questions, k or self.settings.top_k_retrieval)

    def retrieve(self, questions: DataFrame, k: int | None = None) -> DataFrame:
        """As ``search``, with all that retrieval has: variations, vectors if there is an embedder, boosts by heading and by
        entities, and few chunks of a page."""
        s = self.settings
        varied = questions.select("query_id", "text", F.posexplode(understanding.variations(F.col("text"))).alias("variation_id", "variation"))
        wording = varied.select((F.col("query_id") * 16 + F.col("variation_id")).alias("query_id"), F.col("variation").alias("text"))
        lexical = self.index().search(wording, s.top_k_retrieval)
        lists = lexical.select("query_id", "doc_id", "score")
        if self.embedder is not None:
            near = vector.nearest_text(self.vectors, wording, self.embedder, s.top_k_retrieval).select("query_id", F.col("vec_id").alias("doc_id"), "score")
            near = near.join(self.searched.select("doc_id"), "doc_id", "left_semi")
            lists = fusion.hybrid(near, lists, vector_weight=s.vector_weight, lexical_weight=s.bm25_weight)
        ranked = top_k(lists, ["query_id"], s.top_k_retrieval)
        once = fusion.first_wins(ranked.withColumn("variation_id", F.col("query_id") % 16).withColumn("query_id", F.floor(F.col("query_id") / 16)))
        chunks = self.searched
        boosts = fusion.graph_boosts(questions, self.entities, self.links)
        boosted = fusion.boosted(once.select("query_id", "doc_id", "score"), boosts, ["query_id", "doc_id"])
        headed = fusion.heading_rerank(boosted, questions, chunks.select("doc_id", "heading_path")).select("query_id", "doc_id", "score")
        return fusion.diversify(headed, chunks.select("doc_id", F.col("page_id").alias("page")), s.max_chunks_per_page, k or s.top_k_final)

    def answer(self, questions: DataFrame, k: int | None = None) -> DataFrame:
        """A row per question: query_id, question, query_type, confidence, level, answerable, answer, citations, chunks."""
        found = self.retrieve(questions, k)
        rich = found.drop("page").join(self.searched.select("doc_id", "content", "heading_path", "page_title", "page_url"), "doc_id")
        rich = staged(rich, "retrieved")
        sure = understanding.confidence(questions, rich, self.settings.confidence_threshold)
        top = rich.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("doc_id").alias("id"), "content", F.coalesce("page_url", "page_title").alias("source"), "heading_path", "score"))).alias("chunks"))
        rows = questions.select("query_id", F.col("text").alias("question"), understanding.question_type(F.col("text")).alias("query_type"))
        rows = rows.join(sure.select("query_id", F.col("overall").alias("confidence"), "level", "answerable"), "query_id").join(top, "query_id", "left")
        return answers.grounded(rows, self.chat)

    def query(self, question: str, top_k: int | None = None, use_cache: bool = True) -> dict[str, Any]:
        """One question's answer, sources and confidence, and a row in the log."""
        if not question:
            raise ValueError("The question is empty")
        if len(question) > self.settings.max_query_length:
            raise ValueError(f"The question is longer than {self.settings.max_query_length} characters")
        key = (hashlib.sha256(question.strip().lower().encode()).hexdigest(), top_k or self.settings.top_k_final)
        if use_cache and self.settings.query_cache_enabled and (hit := self.cache.get(key)) is not None:
            return {**hit, "cached": True}
        with Timer() as t:
            row = self.answer(self.spark.createDataFrame([(0, question)], "query_id long, text string"), top_k).first()
        chunks = row["chunks"] or []
        sources = list(dict.fromkeys(c["source"] for c in chunks if c["source"]))
        out = {
            "query": question, "query_type": row["query_type"], "answer": row["answer"], "confidence": row["confidence"], "level": row["level"], "sources": sources,
            "chunks": [c.asDict() for c in chunks], "valid_citations": row["valid_citations"], "invalid_citations": row["invalid_citations"], "used_fallback": row["used_fallback"], "cached": False,
        }
        self.log_query(question, row["query_type"], [], [c["id"] for c in chunks], row["confidence"], not row["used_fallback"] and self.chat is not None, {"total_time": t.seconds})
        METRICS.record("query_ms", t.ms)
        if use_cache and self.settings.query_cache_enabled:
            self.cache.put(key, out)
        return out

    # -- log and numbers

    def log_query(self, query: str, query_type: str, expanded: list[str], chunk_ids: list[int], confidence: float | None, answered: bool, seconds: dict[str, float] | None = None) -> str:
        """Appends a row to the query log; times are given in seconds. The row's id."""
        seconds, row_id = seconds or {}, uuid.uuid4().hex
        ms = [None if not seconds.get(n) else seconds[n] * 1000 for n in ("total_time", "embedding_time", "search_time", "rerank_time", "generation_time")]
        row = (row_id, datetime.datetime.fromtimestamp(time.time()), query, query_type, expanded, chunk_ids, confidence, answered, *ms)
        self._append("query_log", self.spark.createDataFrame([row], LOG))
        return row_id

    def _append(self, name: str, df: DataFrame) -> None:
        """The next version of a table points to the folders of the last one and a new one."""
        store = Versioned(self.spark, f"{self.root}/{name}")
        part = f"v-{uuid.uuid4().hex}"
        df.write.parquet(f"{store.root}/{part}")
        store.point_to([*(store.current() or []), part])

    def stats(self) -> dict[str, int]:
        out = analytics.corpus_counts(self.pages, self.chunks, self.vectors, self.entities).first().asDict()
        return {**out, "relationships": self.edges.count()}

    def analytics(self) -> dict[str, Any]:
        log = self.log
        return {**analytics.query_analytics(log).first().asDict(), "by_type": {r["query_type"]: r["n"] for r in analytics.type_counts(log).collect()}}

    def export_log(self, path: str, limit: int | None = None) -> int:
        return export_log_csv(self.log, path, limit)

    # -- graph and summaries

    def extract_entities(self, extractor: extraction.Extractor | None = None, page_id: int | None = None) -> dict[str, int]:
        """Reads the pages without linked chunks; how many entities, relationships and links there are then."""
        extractor = extractor or (extraction.chat_extractor(self.chat) if self.chat is not None else None)
        if extractor is None:
            raise ValueError("extraction needs a chat client or a dictionary")
        pages = self.pages.select("page_id", F.col("parsed_text").alias("text"))
        pages = pages if page_id is None else pages.filter(F.col("page_id") == page_id)
        new = extraction.extract_graph(pages, self.chunks.select("doc_id", "page_id"), self.entities, self.edges, self.links, extractor)
        made = [staged(df, "graph") for df in new]
        for name, df in zip(("entities", "relationships", "chunk_entities"), made):
            self._replace(name, df)
        return dict(zip(("entities", "relationships", "links"), (df.count() for df in made)))

    def export_graph(self, path: str) -> dict[str, int]:
        n, m = export_graph_json(self.entities, graph.export_edges(self.edges, self.entities).drop("json"), path)
        return {"entities": n, "relationships": m}

    def summarizer(self):
        """The chat client's summary of a text, or its beginning where there is no client."""
        if self.chat is None:
            return rollup.extractive
        ask = answers.completion(self.chat)
        return lambda text: F.coalesce(ask(F.concat(F.lit("Summarise this text in two sentences.\n\n"), F.substring(F.coalesce(text, F.lit("")), 1, rollup.READ_CHARS))), F.lit(""))

    def rebuild_summaries(self, force: bool = False) -> dict[str, object]:
        return rollup.rebuild(self.pages.select("page_id", "url", "title", F.col("parsed_text").alias("text")), f"{self.root}/summaries", self.summarizer(), force=force)

    def page_summaries(self) -> DataFrame:
        got = Versioned(self.spark, f"{self.root}/summaries/page_summaries").read()
        return self.spark.createDataFrame([], "page_id long, title string, url string, system string, summary string") if got is None else got

    # -- checks

    def validate(self, fix: bool = False) -> dict[str, int]:
        """Rows at fault by kind; with ``fix``, chunks, vectors and links without their parent are removed and a missing
        index is built."""
        chunks, links, vectors, edges, entities = self.chunks, self.links, self.vectors, self.edges, self.entities
        lost = {
            "vectors without a chunk": analytics.orphans(vectors, chunks, "vec_id", "doc_id"), "links without a chunk": analytics.orphans(links, chunks, "doc_id", "doc_id"),
            "links without an entity": analytics.orphans(links, entities, "entity_id", "entity_id"),
            "relationships without a source": analytics.orphans(edges, entities, "source_id", "entity_id"), "relationships without a target": analytics.orphans(edges, entities, "target_id", "entity_id"),
        }
        found = {r["issue"]: r["n"] for r in analytics.integrity(list(lost.items())).collect()}
        try:
            indexed = self.index().lengths
            found["chunks that are not indexed"] = analytics.orphans(self.searched, indexed, "doc_id", "doc_id").count()
        except Exception:  # no index yet
            found["chunks that are not indexed"] = self.searched.count()
        if fix:
            if found["vectors without a chunk"]:
                self._replace("embeddings", vectors.join(chunks.select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi"))
            if found["links without a chunk"] or found["links without an entity"]:
                self._replace("chunk_entities", links.join(chunks.select("doc_id"), "doc_id", "left_semi").join(entities.select("entity_id"), "entity_id", "left_semi"))
            if found["relationships without a source"] or found["relationships without a target"]:
                ends = lambda side: entities.select(F.col("entity_id").alias(side))
                self._replace("relationships", edges.join(ends("source_id"), "source_id", "left_semi").join(ends("target_id"), "target_id", "left_semi").select(*edges.columns))
            if found["chunks that are not indexed"]:
                self.rebuild_index()
        return found

    def health(self) -> dict[str, Any]:
        def tables() -> str:
            return f"{self.pages.count()} pages"

        def settings() -> str:
            wrong = problems(self.settings)
            if wrong:
                raise ValueError("; ".join(wrong))
            return "settings keep the rules"

        def embedder() -> str | None:
            return None if self.embedder is None else f"{len(self.embedder.embed(['health'])[0])} dimensions"

        def chat() -> str | None:
            return None if self.chat is None else f"{len(self.chat.complete('health'))} characters"

        return Health({"tables": tables, "settings": settings, "embedder": embedder, "chat": chat}).report()
