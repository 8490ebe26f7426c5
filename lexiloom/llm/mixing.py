"""Mixing sources to target weights, with DataFrame functions only.

The words of a source, in a fixed order of its documents, are packed into blocks of ``block_words``. A source whose
target is ``t`` words needs so many slots for blocks; all slots are dealt to output shards of ``shard_blocks``. For each
shard the number of slots of each source is drawn: every place of a shard draws a source with the chance of its share of
all slots, which makes the counts of a shard multinomial. The drawn counts of a source are then scaled to its number of
slots (running totals times slots over draws, rounded down), so that sources meet their targets whatever the draws were;
a source has one draw more than its luck gave it, so that none is left out. A shard's slots are consecutive slots of each
source. A pseudorandom permutation of the source's block indices (swap-or-not, Hoang, Morris and Rogaway 2012: a
permutation of any range, from hashes alone) maps slot to block, epoch after epoch, and blocks are joined by (source,
index). What a document contributes are its pieces in the joined blocks.

Only the last slot of a source may be cut, so a source's words meet its rounded target exactly, and no block is taken in
more epochs than ``cap`` rounded up. Defined results: a null text is empty; an empty text or a source without words has
size 0, target 0 and is never taken; a null source is a source of its own, sorted last; repeated rows count as often as
they stand there, and rows alike in all columns may swap what is taken of them; texts of any length are taken whole; an
empty table gives an empty result; further columns, whatever their names, are carried along by ``apply_mixture`` and
dropped by the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lexiloom.llm.common import WORD, buckets_for, in_order, running_start, text_or_empty, written

ROUNDS = 16
_WORD_AND_SPACE = r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"


def permuted(x: Column, n: Column, *key: Column, inverse: bool = False) -> Column:
    """Swap-or-not: a pseudorandom permutation of 0 .. n-1, its parameters from hashes of ``key``. Each round undoes itself,
    so the rounds in reverse are the inverse."""

    def step(acc: Column, r: Column) -> Column:
        partner = F.pmod(F.xxhash64(r, *key) - acc, n)
        bit = F.xxhash64(F.greatest(acc, partner), r, *key).bitwiseAND(1)
        return F.when(bit == 1, partner).otherwise(acc)

    rounds = range(ROUNDS)[::-1] if inverse else range(ROUNDS)
    return F.aggregate(F.array(*[F.lit(r) for r in rounds]), x.cast("long"), step)


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """A row per source: source, source_size, target, number, by water-filling over sources sorted by code point, null last.

    ``sizes``: (source, source_size). Sources weigh ``weights``, repeating; together they get ``share`` of all words;
    a target stops at ``cap`` times its source's size, and what is above is shared again by weight. Sorted by size over
    weight, the stopped sources are a prefix: the level is the least that an open source can hold. Both orders are global
    ones over partitions, so sources may be many.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("number"), F.lit(len(weights))) + 1).cast("int"))
    s = in_order(sizes, [F.col("source").asc_nulls_last()], "number", {})
    s = s.withColumn("_w", w).withColumn("_top", F.lit(float(cap)) * F.col("source_size")).withColumn("_full", F.col("_top") / F.col("_w"))
    s = written(in_order(s, ["_full", "number"], "_n", {"_stopped": "_top", "_shut": "_w"}), "mixing-sources")
    # single rows
    s = s.crossJoin(F.broadcast(s.agg((F.sum("source_size") * F.lit(float(share))).alias("_all"), F.sum("_w").alias("_open"))))
    level = (F.col("_all") - F.col("_stopped")) / (F.col("_open") - F.col("_shut"))
    # of the fitting levels, the first in this order is the highest
    s = s.crossJoin(F.broadcast(s.agg(F.max(F.when(level * F.col("_w") <= F.col("_top"), level)).alias("_level"))))
    target = F.when(F.col("_level").isNull(), F.col("_top")).otherwise(F.least(F.col("_top"), F.col("_level") * F.col("_w")))
    return s.select("source", "source_size", target.alias("target"), "number")


class Mix:
    """The tables of a mix: documents with their place in their source, shards, slots and pieces of blocks."""

    def __init__(self, docs: DataFrame, weights, share: float, cap: float, block_words: int, shard_blocks: int, seed: int):
        self.block, self.per_shard, self.seed = block_words, shard_blocks, seed
        size = F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long")
        rows = written(docs.select("doc_id", "source", size.alias("size"), row_hash(docs).alias("_h")), "mixing-sizes")
        totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
        n, aim = F.col("n_blocks"), F.round("target").cast("long")
        aims = (
            source_targets(totals, weights, share, cap)
            .withColumn("key", F.xxhash64(F.lit(seed), F.coalesce(F.col("source"), F.lit("")), F.col("source").isNull()))
            .withColumn("n_blocks", F.ceil(F.col("source_size") / block_words).cast("long"))
            .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(aim / F.col("source_size"))).otherwise(0).cast("long"))
            .withColumn("rest", aim - F.col("epochs") * F.col("source_size"))
            .withColumn("short", n * block_words - F.col("source_size"))  # words that the last block lacks
            .withColumn("short_at", F.when(n > 0, permuted(n - 1, n, F.col("key"), inverse=True)).otherwise(0))
            .withColumn("_least", F.ceil(F.col("rest") / block_words).cast("long"))
            .withColumn("_more", F.ceil((F.col("rest") + F.col("short")) / block_words).cast("long"))
            .withColumn("slots", F.col("epochs") * n + F.when(F.col("short_at") < F.col("_least"), F.col("_more")).otherwise(F.col("_least")))
            .drop("_least", "_more")
        )
        self.sources = written(in_order(aims, ["number"], "_i", {"first_slot": "slots"}), "mixing-targets")
        facts = self.sources.select("source", "number", "source_size", "target", "epochs")
        self.placed = written(running_start(rows, ["source"], ["doc_id", "_h"], "size", "begin", buckets_for(rows.count()), facts), "mixing-placed")

    def shards(self) -> DataFrame:
        """number, shard, first, n: the slots of each source in each shard; from the draws."""
        spark = self.placed.sparkSession
        total, most = self.sources.agg(F.sum("slots"), F.count("*")).first()  # one row
        total = int(total or 0)
        width, n_shards = max(1, total // max(1, most)), max(1, -(-total // self.per_shard))
        # a place draws one of all slots, and thereby that slot's source; sources are found by cells of their slots
        at = spark.range(total).select(F.floor(F.col("id") / self.per_shard).alias("shard"), F.pmod(F.xxhash64(F.lit(self.seed), F.lit("draw"), "id"), F.lit(max(1, total))).alias("_r"))
        at = at.withColumn("_cell", F.floor(F.col("_r") / width))
        own = self.sources.filter("slots > 0").select("number", "slots", "first_slot")
        end = F.col("first_slot") + F.col("slots")
        cells = own.withColumn("_c", F.explode(F.sequence(F.floor(F.col("first_slot") / width), F.floor((end - 1) / width))))
        drawn = at.join(cells, (F.col("_cell") == F.col("_c")) & (F.col("_r") >= F.col("first_slot")) & (F.col("_r") < end)).select("number", "shard")
        drawn = drawn.union(own.select("number", F.pmod(F.xxhash64(F.lit(self.seed), "number"), F.lit(n_shards)).alias("shard")))
        counts = written(drawn.groupBy("number", "shard").agg(F.count("*").alias("drawn")), "mixing-draws")
        facts = own.join(counts.groupBy(F.col("number").alias("_of")).agg(F.sum("drawn").alias("_all")), F.col("number") == F.col("_of")).select("number", "slots", "_all")
        c = running_start(counts, ["number"], ["shard"], "drawn", "drawn_before", buckets_for(n_shards, 20_000, 1), facts)
        scaled = lambda x: F.floor(x.cast("decimal(38,0)") * F.col("slots") / F.col("_all")).cast("long")
        c = c.withColumn("first", scaled(F.col("drawn_before"))).withColumn("n", scaled(F.col("drawn_before") + F.col("drawn")) - F.col("first"))
        return c.filter("n > 0").select("number", "shard", "first", "n")

    def slots(self) -> DataFrame:
        """number, shard, place, epoch, block, words (what the slot takes of the block, from its begin), whole (all of it)."""
        s = self.shards()
        in_shard = W.partitionBy("shard")
        s = s.withColumn("_off", F.sum("n").over(in_shard.orderBy("number")) - F.col("n")).withColumn("_of", F.sum("n").over(in_shard))
        s = s.join(self.sources.select("number", "key", "n_blocks", "epochs", "rest", "short", "short_at"), "number")
        s = s.withColumn("_u", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)))
        s = s.withColumn("epoch", F.floor(F.col("_u") / F.col("n_blocks"))).withColumn("_x", F.pmod("_u", "n_blocks"))
        s = s.withColumn("block", permuted(F.col("_x"), F.col("n_blocks"), F.col("key")))
        begin = F.col("_x") * self.block - F.when(F.col("_x") > F.col("short_at"), F.col("short")).otherwise(0)
        length = F.lit(self.block) - F.when(F.col("_x") == F.col("short_at"), F.col("short")).otherwise(0)
        words = F.when(F.col("epoch") < F.col("epochs"), length).otherwise(F.greatest(F.lit(0), F.least(length, F.col("rest") - begin)))
        place = permuted(F.col("_off") + F.col("_u") - F.col("first"), F.col("_of"), F.lit(self.seed), F.col("shard"))
        return s.select("number", "shard", place.alias("place"), "epoch", "block", words.alias("words"), (words == length).alias("whole"))

    def pieces(self, *columns: str) -> DataFrame:
        """A row per document and block: number, block, start (word in the document), at (word in the block), n_words."""
        p = self.placed.filter("size > 0")
        last = F.floor((F.col("begin") + F.col("size") - 1) / self.block)
        p = p.withColumn("block", F.explode(F.sequence(F.floor(F.col("begin") / self.block), last)))
        lo = F.greatest(F.col("begin"), F.col("block") * self.block)
        hi = F.least(F.col("begin") + F.col("size"), (F.col("block") + 1) * self.block)
        return p.select("number", "block", (lo - F.col("begin")).alias("start"), (lo - F.col("block") * self.block).alias("at"), (hi - lo).alias("n_words"), *columns)

    def documents(self) -> DataFrame:
        """doc_id, _h, size, source_size, target, epochs, taken, spans (of the last epoch, in order: start, n_words)."""
        taken = self.slots().groupBy("number", "block").agg(F.sum(F.col("whole").cast("long")).alias("_times"), F.max(F.when(~F.col("whole"), F.col("words"))).alias("_cut"))
        own = ["begin", "doc_id", "_h", "size", "source_size", "target", "epochs"]
        p = self.pieces(*own).join(taken.withColumnsRenamed({"number": "_number", "block": "_block"}), (F.col("number") == F.col("_number")) & (F.col("block") == F.col("_block")), "left")
        times = F.coalesce("_times", F.lit(0))
        cut = F.greatest(F.lit(0), F.least(F.col("n_words"), F.coalesce("_cut", F.lit(0)) - F.col("at")))
        extra = F.when(times > F.col("epochs"), F.col("n_words")).otherwise(cut)
        p = p.select("number", *own, (times * F.col("n_words") + cut).alias("_taken"), F.when(extra > 0, F.struct("start", extra.alias("n_words"))).alias("_span"))
        # a document of any length is one row; its pieces are as many as its blocks
        out = p.groupBy("number", *own).agg(F.sum("_taken").alias("taken"), F.array_sort(F.collect_list("_span")).alias("spans")).drop("number", "begin")
        rest = self.placed.filter("size = 0").select(*own[1:], F.lit(0).cast("long").alias("taken"), F.array().cast(out.schema["spans"].dataType).alias("spans"))
        return out.unionByName(rest)


def row_hash(docs: DataFrame) -> Column:
    """A hash of all columns of a row that have one (maps have none)."""
    return F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()])


def mixture(docs: DataFrame, *, weights=(5, 2, 1), share=1.5, cap=2.0, block_words=256, shard_blocks=4096, seed=17) -> DataFrame:
    """A row per document: doc_id, size, source_size, target (its source's), taken, whole_epochs, spans of the last epoch."""
    d = Mix(docs, weights, share, cap, block_words, shard_blocks, seed).documents()
    return d.select("doc_id", "size", "source_size", "target", "taken", F.col("epochs").cast("int").alias("whole_epochs"), "spans")


def mixture_blocks(docs: DataFrame, *, weights=(5, 2, 1), share=1.5, cap=2.0, block_words=256, shard_blocks=4096, seed=17) -> DataFrame:
    """The mix itself: a row per document and block taken, with the output shard and the place in it.

    doc_id, source, epoch, block, start (word in the document), n_words, shard, place (of the block in its shard).
    """
    m = Mix(docs, weights, share, cap, block_words, shard_blocks, seed)
    s = m.slots().withColumnsRenamed({"number": "_number", "block": "_block"})
    both = m.pieces("doc_id", "source").join(s, (F.col("number") == F.col("_number")) & (F.col("block") == F.col("_block")))
    n = F.least(F.col("n_words"), F.col("words") - F.col("at"))
    return both.withColumn("n_words", n).filter("n_words > 0").select("doc_id", "source", F.col("epoch").cast("int").alias("epoch"), "block", "start", "n_words", "shard", "place")


def apply_mixture(docs: DataFrame, *, weights=(5, 2, 1), share=1.5, cap=2.0, block_words=256, shard_blocks=4096, seed=17) -> DataFrame:
    """The mixed documents, in the columns of ``docs``: a row for each whole epoch and one for the words taken in the
    last epoch (white space stays with the word before it). A document that the mix does not take has no row. Texts move
    once, to meet their document's row of the plan."""
    names = docs.columns
    plan = Mix(docs, weights, share, cap, block_words, shard_blocks, seed).documents().filter("taken > 0")
    plan = written(plan.select(F.col("doc_id").alias("_doc"), "_h", "size", "epochs", "spans"), "mixing-plan")
    wide = docs.select(row_hash(docs).alias("_row"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    doc, text = f"c{names.index('doc_id')}", f"c{names.index('text')}"
    # rows that are alike in all columns: one of them meets the plans of all
    alike = written(plan.groupBy("_doc", "_h").count().filter("count > 1").select(F.col("_doc").alias("_ad"), F.col("_h").alias("_ah")), "mixing-alike")
    if not alike.isEmpty():
        same = F.col(doc).eqNullSafe(F.col("_ad")) & (F.col("_row") == F.col("_ah"))
        one = wide.join(alike, same, "left_semi").withColumn("_n", F.row_number().over(W.partitionBy(doc, "_row").orderBy(F.lit(0)))).filter("_n = 1").drop("_n")
        wide = wide.join(alike, same, "left_anti").union(one)
    p = wide.join(plan.hint("shuffle_hash"), F.col(doc).eqNullSafe(F.col("_doc")) & (F.col("_row") == F.col("_h")))
    part = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["n_words"])
    words = F.regexp_extract_all(F.col(text), F.lit(_WORD_AND_SPACE), F.lit(0))
    cut = F.array_join(F.flatten(F.transform("spans", lambda s: F.slice(words, (s["start"] + 1).cast("int"), s["n_words"].cast("int")))), "")
    copies = F.array_repeat(F.col(text), F.col("epochs").cast("int"))
    texts = F.when(part == 0, copies).when(part == F.col("size"), F.array_append(copies, F.col(text))).otherwise(F.array_append(copies, cut))
    out = p.withColumn("_text", F.explode(texts))
    cols = [(F.col("_text") if c == "text" else F.col(f"c{i}")).alias(c) for i, c in enumerate(names)]
    if "n_chars" in names:
        cols[names.index("n_chars")] = F.length("_text").cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return out.select(*cols)
