"""Questions: kind, key terms, variations; confidence in what was found, context and source lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lexiloom.functions.text import citations, general_tokens, key_terms

# Fixed values.
ERROR_KEYWORDS = ("error", "fail", "failing", "failed", "broken", "not working", "issue", "problem", "bug", "crash", "exception", "timeout", "unable", "cannot", "can't", "couldn't", "won't")
SYNONYMS = (
    ("configure", ("setup", "set up")), ("setup", ("configure", "set up")), ("set up", ("configure", "setup")), ("install", ("set up", "deploy")), ("error", ("issue", "problem")),
    ("issue", ("error", "problem")), ("problem", ("error", "issue")), ("connect", ("connection", "link")), ("connection", ("connect", "link")), ("start", ("begin", "launch")),
    ("stop", ("halt", "terminate")), ("create", ("make", "build")), ("delete", ("remove", "destroy")), ("update", ("modify", "change")), ("get", ("retrieve", "fetch")),
)
MAX_CONTEXT = 4000
SEPARATOR = "\n\n---\n\n"


def question_type(q: Column) -> Column:
    """troubleshooting, procedural, factual, navigational or exploratory, by the first rule that holds."""
    low = F.lower(F.trim(q))
    trouble = F.lit(False)
    for w in ERROR_KEYWORDS:
        trouble = trouble | low.contains(w)
    return (
        F.when(trouble | low.rlike(r"^why\b"), "troubleshooting")
        .when(low.rlike(r"^how\b"), "procedural")
        .when(low.rlike(r"^what\b"), "factual")
        .when(low.rlike(r"^where\b"), "navigational")
        .when(low.rlike(r"^(tell me about|explain|describe|overview)\b"), "exploratory")
        .when(low.rlike(r"\b(find|locate|location)\b"), "navigational")
        .otherwise("factual")
    )


def synonym_variations(q: Column) -> Column:
    """The question, then in lower case with each known word in it replaced by its synonyms; distinct."""
    low = F.lower(q)
    swapped = [F.when(low.contains(w), F.replace(low, F.lit(w), F.lit(s))) for w, syns in SYNONYMS for s in syns]
    made = F.filter(F.array(*swapped), lambda v: v.isNotNull() & (v != low))
    return F.array_distinct(F.concat(F.array(q), made))


def variations(q: Column, most: int = 5) -> Column:
    """Up to ``most`` wordings: the question, synonyms, key terms. A blank question stands alone."""
    terms = F.array_join(key_terms(q), " ")
    every = F.array_distinct(F.concat(synonym_variations(q), F.filter(F.array(terms), lambda t: t != "")))
    return F.when(F.trim(q) == "", F.array(q)).otherwise(F.slice(every, 1, most))


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def weighted_average(values: Column, weights: Column) -> Column:
    """Of two arrays, over their common length; 0 if either is empty or all weights add up to 0."""
    add = lambda x: F.aggregate(x, F.lit(0.0), lambda a, v: a + v)
    total = add(weights.cast("array<double>"))
    paired = F.filter(F.zip_with(values.cast("array<double>"), weights.cast("array<double>"), lambda v, w: v * w), lambda x: x.isNotNull())
    return F.when((F.size(values) > 0) & (F.size(weights) > 0) & (total != 0), add(paired) / total).otherwise(0.0)


def coverage(question: Column, content: Column) -> Column:
    """Share of the question's words, repeated ones again, that the content holds as parts; 0 without words."""
    words, low = general_tokens(question), F.lower(content)
    return F.when(F.size(words) > 0, F.size(F.filter(words, lambda w: low.contains(w))) / F.size(words)).otherwise(0.0)


def level(overall: Column) -> Column:
    return F.when(overall >= 0.8, "high").when(overall >= 0.5, "medium").otherwise("low")


def reasons(overall: Column, retrieval: Column, covered: Column) -> Column:
    """Sentences that say what the confidence rests on."""
    whole = F.when(overall >= 0.7, "High overall confidence in retrieved content").when(overall >= 0.4, "Moderate confidence in retrieved content").otherwise("Low confidence - results may not be relevant")
    found = F.when(retrieval >= 0.7, "Good similarity scores from retrieval").when(retrieval < 0.4, "Low retrieval scores - content may not match well")
    cover = F.when(covered >= 0.7, "Query terms well covered in results").when(covered < 0.4, "Low coverage of query terms in results")
    return F.filter(F.array(whole, found, cover), lambda x: x.isNotNull())


def confidence(questions: DataFrame, results: DataFrame, threshold: float = 0.5) -> DataFrame:
    """query_id, retrieval, coverage, overall, level, answerable for every question; 0 without results.

    ``results``: (query_id, score, content, rank), a top list, so a question's contents fit in a row.
    """
    got = results.groupBy("query_id").agg(
        clamp(0.6 * F.max("score") + 0.4 * F.avg("score")).alias("_r"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "content"))), lambda x: x["content"]), " ").alias("_c"),
    )
    rows = questions.select("query_id", "text").join(got, "query_id", "left")
    rows = rows.select("query_id", F.coalesce("_r", F.lit(0.0)).alias("retrieval"), F.when(F.col("_c").isNull(), 0.0).otherwise(coverage(F.col("text"), F.col("_c"))).alias("coverage"))
    rows = rows.withColumn("overall", clamp(0.6 * F.col("retrieval") + 0.4 * F.col("coverage")))
    return rows.select(
        "query_id", *[F.round(c, 6).alias(c) for c in ("retrieval", "coverage", "overall")], level(F.col("overall")).alias("level"), (F.col("overall") >= threshold).alias("answerable"),
    )


def enrich(results: DataFrame, chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """Results with content, heading path, page title and url; unknown ids pass with nulls.

    ``chunks``: (doc_id, page_id, content, heading_path); ``pages``: (page_id, title, url).
    """
    return results.join(chunks.select("doc_id", "page_id", "content", "heading_path"), "doc_id", "left").join(pages.select("page_id", F.col("title").alias("page_title"), F.col("url").alias("page_url")), "page_id", "left")


def formatted_chunk(content: Column, heading_path: Column | None = None, title: Column | None = None, url: Column | None = None) -> Column:
    text = lambda c: F.nullif(c, F.lit(""))
    parts = []
    if heading_path is not None:
        parts.append(F.concat(F.lit("["), text(heading_path), F.lit("]")))
    if title is not None:
        where = F.lit("") if url is None else F.coalesce(F.concat(F.lit(" ("), text(url), F.lit(")")), F.lit(""))
        parts.append(F.concat(F.lit("Source: "), text(title), where))
    return F.concat_ws("\n", *parts, F.coalesce(content, F.lit("")))


def build_context(results: DataFrame, most: int = MAX_CONTEXT) -> DataFrame:
    """query_id, context: formatted chunks in order of rank up to ``most`` characters (separators not counted). The first
    that does not fit is cut and marked if more than 100 characters are left for it, and ends the context.

    ``results``: (query_id, rank, piece)."""
    over = W.partitionBy("query_id").orderBy("rank").rowsBetween(W.unboundedPreceding, -1)
    rows = results.withColumn("_before", F.coalesce(F.sum(F.length("piece")).over(over), F.lit(0)))
    left = F.lit(most) - F.col("_before")
    fits = F.length("piece") <= left
    rows = rows.withColumn("_shown", F.when(fits, F.col("piece")).when(left > 100, F.concat(F.expr(f"substring(piece, 1, int({most} - _before))"), F.lit("..."))))
    rows = rows.filter(F.col("_shown").isNotNull() & (left >= 0))
    # an overflow ends the context: shorter chunks after it do not come back
    stop = F.max(F.when(~fits, 1).otherwise(0)).over(over)
    rows = rows.withColumn("_stop", F.coalesce(stop, F.lit(0))).filter("_stop = 0")
    pieces = F.array_sort(F.collect_list(F.struct("rank", "_shown")))
    return rows.groupBy("query_id").agg(F.array_join(F.transform(pieces, lambda x: x["_shown"]), SEPARATOR).alias("context"))


def source_list(results: DataFrame, url: str = "page_url") -> DataFrame:
    """query_id, source, position: distinct sources in the order of the results; null and empty ones are left out."""
    first = results.filter(F.coalesce(F.col(url), F.lit("")) != "").groupBy("query_id", F.col(url).alias("source")).agg(F.min("rank").alias("_r"))
    return first.withColumn("position", F.row_number().over(W.partitionBy("query_id").orderBy("_r"))).select("query_id", "source", "position")


def checked_citations(answers: DataFrame, allowed: str = "chunk_ids", text: str = "answer") -> DataFrame:
    """Adds cited, valid_citations, invalid_citations, is_valid: no citation at all is valid."""
    rows = answers.withColumn("cited", citations(F.coalesce(text, F.lit(""))))
    ids = F.coalesce(F.col(allowed).cast("array<long>"), F.array().cast("array<long>"))
    rows = rows.withColumn("valid_citations", F.filter("cited", lambda c: F.array_contains(ids, c)))
    rows = rows.withColumn("invalid_citations", F.filter("cited", lambda c: ~F.array_contains(ids, c)))
    return rows.withColumn("is_valid", F.size("invalid_citations") == 0)
