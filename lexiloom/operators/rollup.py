"""Summaries rolled up from pages over systems to the whole corpus. The summarizer is an expression or a client; what
stands here is extractive: the first characters of a text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.functions.text import clean_text
from lexiloom.functions.urls import system_name
from lexiloom.sources.store import Versioned

READ_CHARS = 5000


def extractive(text: Column, most: int = 120) -> Column:
    """A deterministic stand-in for a model: the beginning of a text's first 5000 characters, on one line."""
    return F.substring(clean_text(F.substring(F.coalesce(text, F.lit("")), 1, READ_CHARS)), 1, most)


def page_summaries(pages: DataFrame, text: str = "text", summarize=extractive, force: bool = False) -> DataFrame:
    """Adds or fills ``summary``; existing ones stay unless ``force``."""
    made = summarize(F.col(text))
    if "summary" in pages.columns and not force:
        made = F.when(F.coalesce("summary", F.lit("")) != "", F.col("summary")).otherwise(made)
    return pages.withColumn("summary", made)


def detect_systems(pages: DataFrame, url: str = "url") -> DataFrame:
    """Adds ``system``, the product that a page's address names."""
    return pages.withColumn("system", system_name(F.col(url)))


def system_rollup(pages: DataFrame, pages_per_part: int = 1000) -> DataFrame:
    """system, part, n_pages, n_lines, content: a line for every page summary of a system that is not empty, by page_id.

    A system of any size is a series of parts (by ranges of ``pages_per_part`` page ids), which in order of ``part`` are the
    whole text: nothing is left out, and no row holds all of a system."""
    line = F.when(F.coalesce("summary", F.lit("")) != "", F.format_string("- %s: %s", F.coalesce("title", F.lit("")), F.col("summary")))
    rows = pages.select("system", F.floor(F.col("page_id") / pages_per_part).alias("part"), "page_id", line.alias("_l"))
    ordered = F.array_sort(F.collect_list(F.when(F.col("_l").isNotNull(), F.struct("page_id", "_l"))))
    out = rows.groupBy("system", "part").agg(F.count("*").alias("n_pages"), F.count("_l").alias("n_lines"), ordered.alias("_ls"))
    return out.select("system", "part", "n_pages", "n_lines", F.array_join(F.transform("_ls", lambda x: x["_l"]), "\n").alias("content"))


def system_summaries(parts: DataFrame, summarize=extractive) -> DataFrame:
    """system, n_pages, n_lines, summary: what ``summarize`` makes of each part's lines, the parts' in order, a line each."""
    rows = parts.select("system", "part", "n_pages", "n_lines", summarize(F.col("content")).alias("_s"))
    made = F.array_sort(F.collect_list(F.when(F.col("_s") != "", F.struct("part", "_s"))))
    out = rows.groupBy("system").agg(F.sum("n_pages").alias("n_pages"), F.sum("n_lines").alias("n_lines"), made.alias("_p"))
    return out.select("system", "n_pages", "n_lines", F.array_join(F.transform("_p", lambda x: x["_s"]), "\n").alias("summary"))


def global_rollup(systems: DataFrame, summarize=None) -> DataFrame:
    """One row: n_systems, n_pages, content: a line for every system's summary that is not empty, by name; of ``summarize``
    if there is one. Systems are the products that addresses name."""
    line = F.when(F.coalesce("summary", F.lit("")) != "", F.format_string("- %s: %s", F.col("system"), F.col("summary")))
    rows = systems.select("system", "n_pages", line.alias("_l"))
    ordered = F.array_sort(F.collect_list(F.when(F.col("_l").isNotNull(), F.struct("system", "_l"))))
    out = rows.agg(F.count("*").alias("n_systems"), F.coalesce(F.sum("n_pages"), F.lit(0)).alias("n_pages"), ordered.alias("_ls"))
    content = F.array_join(F.transform("_ls", lambda x: x["_l"]), "\n")
    return out.select("n_systems", "n_pages", (content if summarize is None else summarize(content)).alias("content"))


def rebuild(pages: DataFrame, folder: str, summarize=extractive, text: str = "text", force: bool = False) -> dict[str, object]:
    """Pages, then systems with their links to pages, then systems' summaries, then the whole corpus, each stage a new
    version of its table under ``folder``; counts, and the errors of stages that failed. A stage that fails leaves its old
    table, and those after it work with that."""
    spark = pages.sparkSession
    store = {n: Versioned(spark, f"{folder}/{n}") for n in ("page_summaries", "page_systems", "system_summaries", "global_summary")}
    done: dict[str, object] = {"errors": []}

    def stage(name: str, make: Callable[[], DataFrame]) -> DataFrame | None:
        try:
            made = store[name].write(make())
            done[name] = made.count()
            return made
        except Exception as e:  # told to the caller; other stages go on with what there is
            done["errors"].append(f"{name}: {str(e).splitlines()[0]}")
            return store[name].read()

    own = stage("page_summaries", lambda: page_summaries(detect_systems(pages), text, summarize, force).select("page_id", "title", "url", "system", "summary"))
    if own is None:
        return done
    stage("page_systems", lambda: own.select("system", "page_id").distinct())
    systems = stage("system_summaries", lambda: system_summaries(system_rollup(own), summarize))
    if systems is not None:
        stage("global_summary", lambda: global_rollup(systems, summarize))
    return done


def summary_list(pages: DataFrame) -> DataFrame:
    """page_id, title, url, summary of the pages that have one."""
    return pages.filter(F.coalesce("summary", F.lit("")) != "").select("page_id", "title", "url", "summary")
