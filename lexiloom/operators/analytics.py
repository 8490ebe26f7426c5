"""Query log, metrics and corpus statistics; integrity of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TIMES = ("total_time_ms", "embedding_time_ms", "search_time_ms", "rerank_time_ms", "generation_time_ms")


def to_ms(seconds: Column) -> Column:
    """Milliseconds; nothing and zero are null."""
    return F.nullif(seconds, F.lit(0.0)) * 1000


def query_analytics(log: DataFrame) -> DataFrame:
    """One row: total_queries, answers_generated, avg_confidence (0 without any) and average times of timed queries, null
    where they are 0."""
    have = [c for c in TIMES if c in log.columns]
    times = [F.nullif(F.round(F.avg(F.when(F.col("total_time_ms").isNotNull(), F.col(c))), 2), F.lit(0.0)).alias(f"avg_{c}") for c in have]
    return log.agg(
        F.count("*").alias("total_queries"), F.coalesce(F.sum(F.when(F.col("answer_generated"), 1).otherwise(0)), F.lit(0)).alias("answers_generated"),
        F.coalesce(F.round(F.avg("confidence_score"), 4), F.lit(0.0)).alias("avg_confidence"), *times,
    )


def type_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("query_type").agg(F.count("*").alias("n"))


def recent(log: DataFrame, n: int = 100) -> DataFrame:
    """The newest ``n`` rows, newest first, ties by the larger id."""
    return log.orderBy(F.desc("timestamp"), F.desc("id")).limit(n)


def metric_aggregates(metrics: DataFrame) -> DataFrame:
    """metric, n, least, most, mean, total of (metric, value)."""
    v = F.col("value")
    return metrics.groupBy("metric").agg(F.count(v).alias("n"), F.min(v).alias("least"), F.max(v).alias("most"), F.round(F.avg(v), 6).alias("mean"), F.round(F.sum(v), 4).alias("total"))


def windowed_counts(log: DataFrame, every: str = "1 day") -> DataFrame:
    """Counts by window and type; on a stream, with a watermark on ``timestamp`` set by the caller."""
    w = F.window("timestamp", every)
    return log.groupBy(w.alias("w"), "query_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "query_type", "n")


def corpus_counts(pages: DataFrame, chunks: DataFrame, vectors: DataFrame, entities: DataFrame) -> DataFrame:
    """One row of counts: pages, chunks, embedded, entities. Four single rows are joined."""
    one = lambda df, c, e="*": df.agg(F.count(e).alias(c))
    return one(pages, "pages").crossJoin(one(chunks, "chunks")).crossJoin(one(vectors, "embedded", "embedding")).crossJoin(one(entities, "entities"))


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Rows of ``child`` whose key is set and not in ``parent``."""
    keys = parent.select(F.col(parent_key).alias("_k")).distinct()
    return child.filter(F.col(child_key).isNotNull()).join(keys, F.col(child_key) == F.col("_k"), "left_anti")


def integrity(checks: list[tuple[str, DataFrame]]) -> DataFrame:
    """issue, n for each named check, whose DataFrame holds the rows at fault; 0 where all is well."""
    out = None
    for name, bad in checks:
        row = bad.agg(F.count("*").alias("n")).select(F.lit(name).alias("issue"), "n")
        out = row if out is None else out.unionByName(row)
    return out
