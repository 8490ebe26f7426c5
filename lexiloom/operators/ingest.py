"""From raw pages to the tables of the index: sanitise, parse, detect changes, chunk."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.functions.chunks import LARGE, OVERLAP, SMALL, chunk_markdown, chunk_rows
from lexiloom.functions.html import parse_page
from lexiloom.functions.text import content_hash, sanitize_html
from lexiloom.sources.store import bounded_batches

MOST_CHARS = 50_000_000


def latest(pages: DataFrame) -> DataFrame:
    """One row for each url: the one with the largest page_id."""
    return pages.groupBy("url").agg(F.max_by(F.struct("page_id", "html"), "page_id").alias("_p")).select("_p.page_id", "url", "_p.html")


def prepared(pages: DataFrame, most_chars: int = MOST_CHARS) -> DataFrame:
    """page_id, url, html (sanitised), content_hash; longer pages and null ones are left out."""
    rows = pages.filter(F.length("html") <= most_chars)
    return rows.select("page_id", "url", sanitize_html(F.col("html")).alias("html")).withColumn("content_hash", content_hash(F.col("html")))


def changes(incoming: DataFrame, current: DataFrame) -> DataFrame:
    """Adds ``change``: new, changed or same, against (url, content_hash) of what is stored. One join on url."""
    old = current.select(F.col("url").alias("_url"), F.col("content_hash").alias("_hash"))
    kind = F.when(F.col("_url").isNull(), "new").when(F.col("_hash").eqNullSafe(F.col("content_hash")), "same").otherwise("changed")
    return incoming.join(old, F.col("url") == F.col("_url"), "left").withColumn("change", kind).drop("_url", "_hash")


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, url, content_hash, title, parsed_text (Markdown): one pass through a Python worker."""
    bounded_batches(pages.sparkSession)
    return pages.withColumn("_p", parse_page(F.col("html"), F.col("url"))).select("page_id", "url", "content_hash", F.col("_p.title").alias("title"), F.col("_p.markdown").alias("parsed_text"))


def chunked(parsed_pages: DataFrame, small: int = SMALL, large: int = LARGE, overlap: int = OVERLAP) -> DataFrame:
    """A row per large and small chunk of each page; see ``functions.chunks.chunk_rows``."""
    bounded_batches(parsed_pages.sparkSession)
    return chunk_rows(parsed_pages.select("page_id", chunk_markdown(small, large, overlap)(F.col("parsed_text")).alias("chunks")))


def merged(current: DataFrame, incoming: DataFrame, key: str = "url") -> DataFrame:
    """``current`` with the rows of ``incoming`` in place of those with their keys: the next version of a table."""
    return current.join(incoming.select(key).distinct(), key, "left_anti").unionByName(incoming, allowMissingColumns=True)
