"""Structured Streaming: landing pages into the index, and the query log into windows. Batch and stream share code."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.operators import ingest
from lexiloom.operators.analytics import windowed_counts
from lexiloom.sources.store import Bucketed, staged


def landing(spark: SparkSession, path: str, schema: str, per_batch: int | None = None) -> DataFrame:
    """Files of a folder as a stream; needs the schema up front."""
    r = spark.readStream.schema(schema)
    return (r.option("maxFilesPerTrigger", per_batch) if per_batch else r).parquet(path)


def index_pages(pages: DataFrame, root: str, checkpoint: str) -> None:
    """Runs until the landing folder is read: each micro-batch is prepared, set against the stored pages and merged."""
    pages.writeStream.foreachBatch(lambda batch, _: index_batch(batch, root)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def index_batch(batch: DataFrame, root: str, buckets: int = 64) -> dict[str, int]:
    """Merges raw pages (page_id, url, html) into the stored pages and chunks; how many were new, changed and same.

    Both tables lie in buckets of the url's hash, and only buckets that the batch touches are read and written. Unchanged
    pages are skipped, changed ones take the place of their old rows and chunks. Chunks are replaced before pages, so a
    batch that is run again after a failure finds its pages changed still, or unchanged and changes nothing.
    """
    spark = batch.sparkSession
    store, parts = Bucketed(spark, f"{root}/pages", "url", buckets), Bucketed(spark, f"{root}/chunks", "url", buckets)
    rows = ingest.prepared(ingest.latest(batch))
    old = store.read_buckets(store.touched(rows.select("url")))
    if old is None:
        rows = rows.withColumn("change", F.lit("new"))
    else:
        rows = ingest.changes(rows, old)
    rows = staged(rows, "index-batch")
    counts = {r["change"]: r["n"] for r in rows.groupBy("change").agg(F.count("*").alias("n")).collect()}
    new = staged(ingest.parsed(rows.filter("change <> 'same'").drop("change")), "index-parsed")
    numbers = store.touched(new.select("url"))
    if numbers:
        made = ingest.chunked(new).join(new.select("page_id", "url"), "page_id")
        kept, had = parts.read_buckets(numbers), store.read_buckets(numbers)
        if kept is not None:
            made = kept.join(new.select("url"), "url", "left_anti").unionByName(made)
        parts.write_buckets(made, numbers)
        store.write_buckets(new if had is None else ingest.merged(had, new), numbers)
    return {k: counts.get(k, 0) for k in ("new", "changed", "same")}


def log_windows(log: DataFrame, out: str, checkpoint: str, every: str = "1 day", late: str = "1 hour") -> None:
    """Closed windows of a log stream (timestamp, query_type) to Parquet; rows later than ``late`` are dropped."""
    counts = windowed_counts(log.withWatermark("timestamp", late), every)
    counts.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def running_type_counts(log: DataFrame, name: str, checkpoint: str) -> DataFrame:
    """Counts by type over all of a stream, as a table in memory of as many rows as there are types."""
    q = log.groupBy("query_type").agg(F.count("*").alias("n"))
    run = q.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    run.awaitTermination()
    return log.sparkSession.table(name)
