"""Knowledge graph of entities, typed edges and links to documents, as three DataFrames.

entities: (entity_id, name, type, description, normalized_name); edges: (source_id, target_id, type, description);
links: (doc_id, entity_id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lexiloom.functions.text import general_tokens, normalize_name


def _filled(*names: str) -> Column:
    ok = F.lit(True)
    for n in names:
        ok = ok & (F.coalesce(F.col(n).cast("string"), F.lit("")) != "")
    return ok


def valid_entities(found: DataFrame) -> DataFrame:
    return found.filter(_filled("name", "type"))


def valid_relationships(found: DataFrame) -> DataFrame:
    return found.filter(_filled("source", "target", "type"))


def number_entities(mentions: DataFrame, known: DataFrame | None, by: Column, key: str) -> DataFrame:
    """Entities of (name, type, description, ord): one for each value of ``by``, called ``key`` among the known ones. The
    first mention's attributes win and known entities stay as they are. New ids follow the largest known one in the order
    of first mentions.

    New entities are numbered in ranges of ``ord``, each range by itself after a sum over range counts, so no task
    numbers them all.
    """
    rows = valid_entities(mentions).withColumn("_key", by)
    first = rows.groupBy("_key").agg(F.min_by(F.struct("name", "type", "description"), "ord").alias("e"), F.min("ord").alias("ord"))
    if known is not None:
        first = first.join(known.select(F.col(key).alias("_key")), "_key", "left_anti")
        start = known.agg(F.coalesce(F.max("entity_id"), F.lit(-1)) + 1).first()[0]
    else:
        start = 0
    bucket = F.floor(F.col("ord") / 100_000)
    new = first.withColumn("_b", bucket)
    sizes = new.groupBy("_b").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    new = new.join(sizes.withColumn("_before", before).drop("_n"), "_b")
    at = F.row_number().over(W.partitionBy("_b").orderBy("ord", "_key")) - 1
    new = new.select((F.col("_before") + at + start).alias("entity_id"), "e.name", "e.type", "e.description", normalize_name(F.col("e.name")).alias("normalized_name"))
    return new if known is None else known.select(*new.columns).unionByName(new)


def resolve_entities(mentions: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """As ``number_entities``, one entity for each normalised name."""
    return number_entities(mentions, known, normalize_name(F.col("name")), "normalized_name")


def link_entities(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """Distinct (doc_id, entity_id) of mentions (doc_id, name)."""
    rows = mentions.select("doc_id", normalize_name(F.col("name")).alias("normalized_name"))
    return rows.join(entities.select("normalized_name", "entity_id"), "normalized_name").select("doc_id", "entity_id").distinct()


def resolve_relationships(found: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges of (source, target, type, description, ord) whose ends are known; the first of equal ones wins."""
    end = lambda side: entities.select(F.col("normalized_name").alias(f"_{side}"), F.col("entity_id").alias(f"{side}_id"))
    rows = valid_relationships(found).withColumn("_source", normalize_name(F.col("source"))).withColumn("_target", normalize_name(F.col("target")))
    rows = rows.join(end("source"), "_source").join(end("target"), "_target")
    return rows.groupBy("source_id", "target_id", "type").agg(F.min_by("description", "ord").alias("description"))


def unlinked(pages: DataFrame, chunks: DataFrame, links: DataFrame) -> DataFrame:
    """Pages none of whose chunks is linked: what an extraction has yet to read. ``chunks``: (doc_id, page_id)."""
    done = chunks.join(links.select("doc_id"), "doc_id", "left_semi").select("page_id")
    return pages.join(done, "page_id", "left_anti")


def find_entity(entities: DataFrame, name: str) -> DataFrame:
    return entities.filter(F.col("normalized_name") == name.strip().lower())


def neighbours(edges: DataFrame, entities: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """entity_id, other_id, other_name, type, direction over all edges, or those at the entities ``of`` (entity_id)."""
    out = edges.select(F.col("source_id").alias("entity_id"), F.col("target_id").alias("other_id"), "type", F.lit("outgoing").alias("direction"))
    back = edges.select(F.col("target_id").alias("entity_id"), F.col("source_id").alias("other_id"), "type", F.lit("incoming").alias("direction"))
    rows = out.unionByName(back)
    if of is not None:
        rows = rows.join(of.select("entity_id").distinct(), "entity_id", "left_semi")
    return rows.join(entities.select(F.col("entity_id").alias("other_id"), F.col("name").alias("other_name")), "other_id")


def entity_documents(links: DataFrame, docs: DataFrame, of: DataFrame) -> DataFrame:
    return links.join(of.select("entity_id").distinct(), "entity_id", "left_semi").join(docs, "doc_id")


def direct_paths(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """from_id, to_id, type, direction for (from_id, to_id) pairs joined by an edge: a forward one before a backward one,
    then the least type. Paths are one edge long."""
    forward = pairs.join(edges, (F.col("from_id") == F.col("source_id")) & (F.col("to_id") == F.col("target_id"))).select("from_id", "to_id", "type", F.lit("forward").alias("direction"))
    backward = pairs.join(edges, (F.col("from_id") == F.col("target_id")) & (F.col("to_id") == F.col("source_id"))).select("from_id", "to_id", "type", F.lit("reverse").alias("direction"))
    best = forward.unionByName(backward).groupBy("from_id", "to_id").agg(F.min(F.struct("direction", "type")).alias("b"))
    return best.select("from_id", "to_id", "b.type", "b.direction")


def search_entities(entities: DataFrame, question: Column) -> DataFrame:
    """Entities whose name or description holds any word of the question as a part."""
    low = F.lower(F.concat_ws("\n", "name", "description"))
    return entities.filter(F.exists(general_tokens(question), lambda t: low.contains(t)))


def subgraph(entities: DataFrame, edges: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """entity_id, name, direction, type, other_id, other_name: a row for each edge at each entity (or those ``of``), and one
    without an edge for an entity that has none. An entity may have any number of edges; no row holds them all."""
    near = neighbours(edges, entities, of)
    own = entities.select("entity_id", "name")
    if of is not None:
        own = own.join(of.select("entity_id").distinct(), "entity_id", "left_semi")
    return own.join(near, "entity_id", "left").select("entity_id", "name", "direction", "type", "other_id", "other_name")


def entity_context(results: DataFrame, links: DataFrame, entities: DataFrame, edges: DataFrame, most: int = 10) -> DataFrame:
    """query_id, entity_lines, relation_lines: entities of the found documents in the order they are first seen, and the
    edges with both ends among them; ``most`` of each."""
    seen = results.select("query_id", "doc_id", "rank").join(links, "doc_id").groupBy("query_id", "entity_id").agg(F.min("rank").alias("first"))
    named = seen.join(entities.select("entity_id", "name", "type"), "entity_id")
    top = named.withColumn("_n", F.row_number().over(W.partitionBy("query_id").orderBy("first", "entity_id"))).filter(F.col("_n") <= most)
    lines = lambda n, text: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(n, text))), lambda x: x["_t"]), "\n")
    top = top.withColumn("_t", F.format_string("- %s (%s)", "name", "type")).groupBy("query_id").agg(lines("_n", "_t").alias("entity_lines"))
    a = named.select("query_id", F.col("entity_id").alias("source_id"), F.col("name").alias("_from"))
    b = named.select("query_id", F.col("entity_id").alias("target_id"), F.col("name").alias("_to"))
    rel = edges.select("source_id", "target_id", F.col("type").alias("_type")).join(a, "source_id").join(b, ["query_id", "target_id"])
    rel = rel.withColumn("_n", F.row_number().over(W.partitionBy("query_id").orderBy("source_id", "target_id", "_type"))).filter(F.col("_n") <= most)
    rel = rel.withColumn("_t", F.format_string("- %s %s %s", "_from", "_type", "_to")).groupBy("query_id").agg(lines("_n", "_t").alias("relation_lines"))
    return top.join(rel, "query_id", "left").select("query_id", "entity_lines", F.coalesce("relation_lines", F.lit("")).alias("relation_lines"))


def export_edges(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges with the names of both ends and as a JSON line."""
    end = lambda side: entities.select(F.col("entity_id").alias(f"{side}_id"), F.col("name").alias(f"{side}_name"))
    rows = edges.join(end("source"), "source_id").join(end("target"), "target_id")
    fields = ["source_id", "source_name", "target_id", "target_name", "type"]
    return rows.select(*fields, F.to_json(F.struct(*fields)).alias("json"))
