"""Crawl sessions and embedding jobs: small state tables with a status each, kept as versions that replace one another.

A session is one crawl of a site: its counters, its queue and what it has visited. One of status ``active`` may be taken
by one worker only (the pointer of a version can be made once, so of two takers one fails). An interrupted session goes on
where it stopped.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lexiloom.operators.crawl import fifo
from lexiloom.sources.store import Versioned, staged

SESSION = "session_id string, start_url string, status string, holder string, pages_crawled long, pages_failed long, pages_skipped long, started_at double, updated_at double"
QUEUE = "session_id string, id long, url string, added_at double, state string"
JOB = "job_id string, page_id long, status string, total long, done long, failed long, rate_limited boolean, updated_at double"
STATES = ("active", "interrupted", "completed", "failed")
JOB_STATES = ("in_progress", "interrupted", "completed", "failed")


class _Table:
    def __init__(self, spark: SparkSession, root: str, schema: str):
        self.spark, self.store, self.schema = spark, Versioned(spark, root), schema

    def rows(self) -> DataFrame:
        got = self.store.read()
        return self.spark.createDataFrame([], self.schema) if got is None else got

    def replace(self, df: DataFrame) -> None:
        self.store.write(staged(df, "state"))


class CrawlSessions:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.sessions, self.queue = _Table(spark, f"{root}/sessions", SESSION), _Table(spark, f"{root}/queue", QUEUE)

    def open(self, start_url: str, fresh: bool = False, holder: str | None = None) -> str:
        """The newest session of ``start_url`` that is not completed, taken by ``holder``; or a new one."""
        now, holder = time.time(), holder or uuid.uuid4().hex
        rows = self.sessions.rows()
        old = rows.filter((F.col("start_url") == start_url) & F.col("status").isin("interrupted", "failed")).orderBy(F.desc("started_at")).first()
        if old is not None and not fresh:
            taken = F.col("session_id") == old["session_id"]
            self.sessions.replace(rows.withColumns({"status": F.when(taken, "active").otherwise(F.col("status")), "holder": F.when(taken, holder).otherwise(F.col("holder")), "updated_at": F.when(taken, now).otherwise(F.col("updated_at"))}))
            return old["session_id"]
        sid = uuid.uuid4().hex
        self.sessions.replace(rows.unionByName(self.spark.createDataFrame([(sid, start_url, "active", holder, 0, 0, 0, now, now)], SESSION)))
        self.enqueue(sid, self.spark.createDataFrame([(start_url,)], "url string"))
        return sid

    def enqueue(self, session_id: str, urls: DataFrame) -> int:
        """Adds the urls that the session has not seen, in their order of (found, url); how many."""
        rows = self.queue.rows()
        mine = rows.filter(F.col("session_id") == session_id)
        last = mine.agg(F.coalesce(F.max("id"), F.lit(-1))).first()[0]
        order = [c for c in ("found", "url") if c in urls.columns]
        one = urls.groupBy("url").agg(*[F.min(c).alias(c) for c in order if c != "url"], F.lit(1).alias("_one"))
        new = staged(one.join(mine.select("url"), "url", "left_anti"), "frontier")
        n = new.count()
        if n:
            # a page's links at a time: bounded by what one step of a crawl finds
            numbered = new.withColumn("id", F.row_number().over(W.orderBy(*order)) + F.lit(last))
            self.queue.replace(rows.unionByName(numbered.select(F.lit(session_id).alias("session_id"), F.col("id").cast("long").alias("id"), "url", F.lit(time.time()).alias("added_at"), F.lit("queued").alias("state"))))
        return n

    def take(self, session_id: str, n: int = 1) -> list[str]:
        """The next ``n`` urls, first in first out; they count as visited from now on."""
        rows = self.queue.rows()
        got = [(r["id"], r["url"]) for r in fifo(rows.filter((F.col("session_id") == session_id) & (F.col("state") == "queued")), n).orderBy("position").collect()]
        if got:
            mine = (F.col("session_id") == session_id) & F.col("id").isin([i for i, _ in got])
            self.queue.replace(rows.withColumn("state", F.when(mine, "visited").otherwise(F.col("state"))))
        return [u for _, u in got]

    def record(self, session_id: str, crawled: int = 0, failed: int = 0, skipped: int = 0, status: str | None = None) -> None:
        if status is not None and status not in STATES:
            raise ValueError(f"no such status: {status}")
        mine = F.col("session_id") == session_id
        add = {c: F.col(c) + F.when(mine, n).otherwise(0) for c, n in (("pages_crawled", crawled), ("pages_failed", failed), ("pages_skipped", skipped))}
        add["updated_at"] = F.when(mine, time.time()).otherwise(F.col("updated_at"))
        if status:
            add["status"] = F.when(mine, status).otherwise(F.col("status"))
        self.sessions.replace(self.sessions.rows().withColumns(add))

    def listed(self) -> DataFrame:
        """Sessions, newest first, with how many urls wait."""
        waits = self.queue.rows().filter("state = 'queued'").groupBy("session_id").agg(F.count("*").alias("queued"))
        return self.sessions.rows().join(waits, "session_id", "left").withColumn("queued", F.coalesce("queued", F.lit(0))).orderBy(F.desc("started_at"))


class EmbeddingJobs:
    """in_progress, then completed, interrupted or failed; a job that is not completed is resumed by running it again, as
    a backfill takes what has no vector yet."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.table = spark, _Table(spark, root, JOB)

    def start(self, total: int, page_id: int | None = None) -> str:
        job = uuid.uuid4().hex
        self.table.replace(self.table.rows().unionByName(self.spark.createDataFrame([(job, page_id, "in_progress", total, 0, 0, False, time.time())], JOB)))
        return job

    def update(self, job: str, done: int | None = None, failed: int | None = None, status: str | None = None, rate_limited: bool | None = None) -> None:
        if status is not None and status not in JOB_STATES:
            raise ValueError(f"no such status: {status}")
        mine = F.col("job_id") == job
        given = {"done": done, "failed": failed, "status": status, "rate_limited": rate_limited, "updated_at": time.time()}
        self.table.replace(self.table.rows().withColumns({c: F.when(mine, F.lit(v)).otherwise(F.col(c)) for c, v in given.items() if v is not None}))

    def get(self, job: str) -> dict | None:
        row = self.table.rows().filter(F.col("job_id") == job).first()
        return None if row is None else row.asDict()

    def unfinished(self) -> DataFrame:
        return self.table.rows().filter("status in ('in_progress', 'interrupted', 'failed')")
