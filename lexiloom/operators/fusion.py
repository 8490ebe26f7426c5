"""Ranked lists: normalising, merging, boosting, diversifying. A list is rows (query_id, doc_id, score)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lexiloom.functions.text import general_tokens
from lexiloom.operators.lexical import top_k

VECTOR_WEIGHT, BM25_WEIGHT = 0.7, 0.3
HEADING_BOOST, GRAPH_BOOST = 1.3, 1.2


def minmax(scores: DataFrame, by: str = "query_id") -> DataFrame:
    """Scores moved to 0 .. 1 in each list; a list of equal scores is all 1."""
    lo, hi = (f("score").over(W.partitionBy(by)) for f in (F.min, F.max))
    scaled = F.when(hi == lo, 1.0).otherwise((F.col("score") - lo) / F.nullif(hi - lo, F.lit(0.0)))
    return scores.withColumn("score", scaled)


def merge(vector: DataFrame, lexical: DataFrame, vector_weight: float = VECTOR_WEIGHT, lexical_weight: float = BM25_WEIGHT) -> DataFrame:
    """query_id, doc_id, score: the weighted sum of two lists, what a list lacks counts 0; nothing is cut off."""
    a = minmax(vector).select("query_id", "doc_id", (F.col("score") * vector_weight).alias("s"))
    b = minmax(lexical).select("query_id", "doc_id", (F.col("score") * lexical_weight).alias("s"))
    return a.unionByName(b).groupBy("query_id", "doc_id").agg(F.sum("s").alias("score"))


def hybrid(vector: DataFrame | None, lexical: DataFrame, **weights) -> DataFrame:
    """Merged lists; without vectors, the lexical list with its own scores."""
    return lexical.select("query_id", "doc_id", "score") if vector is None else merge(vector, lexical, **weights)


def first_wins(lists: DataFrame) -> DataFrame:
    """Of (query_id, variation_id, doc_id, score, rank), a document's first row in the order of variations and ranks."""
    order = W.partitionBy("query_id", "doc_id").orderBy("variation_id", "rank")
    return lists.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def boosted(scores: DataFrame, boosts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Scores times the boost of (doc_id[, query_id], boost); others stay."""
    on = by or ["doc_id"]
    return scores.join(boosts.select(*on, "boost"), on, "left").withColumn("score", F.col("score") * F.coalesce("boost", F.lit(1.0))).drop("boost")


def heading_boost(score: Column, question: Column, heading_path: Column, boost: float = HEADING_BOOST) -> Column:
    """Once, if any word of the question (common ones too) is part of the heading path."""
    low = F.lower(F.coalesce(heading_path, F.lit("")))
    hit = F.exists(general_tokens(question), lambda t: low.contains(t))
    return F.when(F.coalesce(hit, F.lit(False)), score * boost).otherwise(score)


def heading_rerank(scores: DataFrame, questions: DataFrame, headings: DataFrame, k: int | None = None) -> DataFrame:
    """Boosted and ranked lists. ``questions``: (query_id, text); ``headings``: (doc_id, heading_path)."""
    rows = scores.join(questions.select("query_id", F.col("text").alias("_q")), "query_id").join(headings.select("doc_id", "heading_path"), "doc_id", "left")
    rows = rows.withColumn("score", heading_boost(F.col("score"), F.col("_q"), F.col("heading_path"))).select("query_id", "doc_id", "score")
    return top_k(rows, ["query_id"], k or 2147483647)


def diversify(scores: DataFrame, pages: DataFrame, per_page: int = 2, k: int = 5) -> DataFrame:
    """query_id, doc_id, page, score, rank: the best ``k`` of a list with at most ``per_page`` of a page; documents
    without a page are a page together. Whether a document is let in depends only on better ones of its own page, so
    two ranking limits give what a scan in order gives."""
    rows = scores.join(pages.select("doc_id", "page"), "doc_id", "left").withColumn("score", F.round("score", 6))
    in_page = F.row_number().over(W.partitionBy("query_id", "page").orderBy(F.desc("score"), "doc_id"))
    rows = rows.withColumn("_p", in_page).filter(F.col("_p") <= per_page)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "doc_id", "page", "score", "rank")


def graph_boosts(questions: DataFrame, entities: DataFrame, links: DataFrame, boost: float = GRAPH_BOOST) -> DataFrame:
    """query_id, doc_id, boost for documents linked to an entity whose normalised name is a word of the question.

    ``entities``: (entity_id, normalized_name); ``links``: (doc_id, entity_id).
    """
    words = questions.select("query_id", F.explode(general_tokens(F.col("text"))).alias("_w")).distinct()
    found = words.join(entities, F.col("_w") == F.col("normalized_name")).join(links, "entity_id")
    return found.select("query_id", "doc_id").distinct().withColumn("boost", F.lit(boost))


def ordered_chunks(chunks: DataFrame, by: str) -> DataFrame:
    """In order of score (best first) or of position; any other key leaves the order."""
    keys = {"score": [F.desc("score"), "doc_id"], "position": ["chunk_index", "doc_id"]}
    return chunks.orderBy(*keys[by]) if by in keys else chunks
