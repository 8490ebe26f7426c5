"""Crawl operators over a link graph: breadth-first frontiers, FIFO queues, filters and outcome counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType
from pyspark.sql.window import Window as W

from lexiloom.functions import urls
from lexiloom.sources.store import staged, staging_path


def crawlable(found: DataFrame, url: str, allowed: list[str], excluded: list[str], included: list[str] | None = None, robots: dict | None = None) -> DataFrame:
    """Rows whose url may be visited: own domain, paths, kind of file and robots rules."""
    u = F.col(url)
    ok = urls.same_domain(u, allowed) & ~urls.excluded(u, excluded) & urls.included(u, included) & urls.html_like(u)
    if robots:
        ok = ok & urls.may_fetch(urls.path(u), robots["allow"], robots["disallow"])
    return found.filter(ok)


def bfs(links: DataFrame, seeds: DataFrame, most_depth: int | None = None) -> DataFrame:
    """node, depth: what is reachable from ``seeds`` (node) over ``links`` (src, dst), by breadth-first levels.

    Each level is an anti-join of the frontier's targets with what was visited. Distinct edges are written once; levels are
    written as parts of one table in the shared folder, which the next level reads, so no plan grows with the depth and
    lost executors cost one level at most.
    """
    spark = links.sparkSession
    edges = staged(links.select("src", "dst").distinct(), "bfs-edges")
    seen = staging_path(spark, "bfs-levels")
    start = seeds.select("node").distinct()
    start.write.parquet(f"{seen}/depth=0")
    schema = StructType([start.schema["node"], StructField("depth", IntegerType())])
    visited, depth = (lambda: spark.read.schema(schema).parquet(seen)), 0
    while most_depth is None or depth < most_depth:
        frontier = visited().filter(F.col("depth") == depth)
        nxt = edges.join(frontier.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
        depth += 1
        nxt.join(visited().select("node"), "node", "left_anti").write.parquet(f"{seen}/depth={depth}")
        if visited().filter(F.col("depth") == depth).isEmpty():
            break
    return visited()


def fifo(queue: DataFrame, n: int, by: str = "session_id") -> DataFrame:
    """The next ``n`` entries of each session's queue, in order of (added_at, id)."""
    order = W.partitionBy(by).orderBy("added_at", "id")
    return queue.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= n)


def outcome_counts(log: DataFrame, outcome: str = "outcome") -> DataFrame:
    return log.groupBy(outcome).agg(F.count("*").alias("n"))
