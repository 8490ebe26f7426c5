"""Connected components by alternating large-star and small-star (Kiveris et al. 2014), on DataFrames.

Edges are rows (a, b) of longs. In a large-star each node hands its smallest neighbour (or itself) to its larger
neighbours; in a small-star to its smaller ones. Both keep the components; together they end, after about log squared
of the longest path in rounds, in stars around the smallest nodes. A node's edges are never gathered: its minimum is a
pre-aggregated sum-like column, joined back to its edges (a join that adaptive execution splits where a node is hot).
Each round is written to the shared folder, so no round depends on executors of the round before. No edges give no rows;
edges that repeat, or join a node to itself, change nothing; edges with a null end are left out.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from lexiloom.llm.common import written


def _minima(e: DataFrame, key: str) -> DataFrame:
    return e.groupBy(F.col(key).alias("_k")).agg(F.min("b" if key == "a" else "a").alias("_m"))


def large_star(e: DataFrame) -> DataFrame:
    both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    m = _minima(both, "a").withColumn("_m", F.least("_k", "_m"))
    out = both.join(m, F.col("a") == F.col("_k")).filter("b > a").select(F.col("_m").alias("a"), "b")
    return out.filter("a <> b").distinct()


def small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    m = down.groupBy(F.col("u").alias("_k")).agg(F.min("v").alias("_m"))
    out = down.join(m, F.col("u") == F.col("_k"))
    linked = out.select(F.col("_m").alias("a"), F.col("v").alias("b"))
    own = m.select(F.col("_m").alias("a"), F.col("_k").alias("b"))
    return linked.union(own).filter("a <> b").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """node, component (the smallest node reachable) of all nodes that have an edge; others have no row."""
    e = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).filter("a <> b").distinct()
    before = None
    for _ in range(most_rounds):
        # what a round has made is counted while it is written
        seen = Observation()
        e = written(small_star(large_star(e)).observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")), "components")
        now = (seen.get["n"], seen.get["h"])
        if now == before or not now[0]:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return e.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("component")).union(e.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())


def cross_blocks(members: DataFrame, block: int) -> DataFrame:
    """Deals members (g, rep, component, weight, ...) to blocks (g, _i, _j), so that any two of a ``g`` that lie in
    different components meet in a block. A block holds about ``2 * block`` of weight, whatever the size of ``g``; chunks of
    one same component do not meet."""
    extra = [c for c in members.columns if c not in ("g", "rep", "component", "weight")]
    sizes = members.groupBy(F.col("g").alias("_g"), F.col("component").alias("_o")).agg(F.sum("weight").alias("_n"))
    small = sizes.groupBy(F.col("_g").alias("_sg")).agg(F.sum(F.when(F.col("_n") < block, F.col("_n")).otherwise(0)).alias("_small"))
    sizes = sizes.join(small, F.col("_g") == F.col("_sg"))
    own = F.col("_n") >= block
    dealt = members.join(sizes, (F.col("g") == F.col("_g")) & (F.col("component") == F.col("_o")))
    slot = F.when(own, F.pmod(F.xxhash64("rep"), F.ceil(F.col("_n") / block))).otherwise(F.pmod(F.xxhash64("component"), F.greatest(F.lit(1), F.ceil(F.col("_small") / block))))
    pure = F.when(own, F.col("component"))
    dealt = written(dealt.select("g", "rep", "component", *extra, F.xxhash64(own, F.coalesce(pure, F.lit(0)), slot).alias("_c"), pure.alias("_pure")), "cross-dealt")
    chunks = dealt.select("g", "_c", "_pure").distinct()
    other = chunks.select(F.col("g").alias("_og"), F.col("_c").alias("_j"), F.col("_pure").alias("_opure"))
    pairs = chunks.join(other, (F.col("g") == F.col("_og")) & (F.col("_c") <= F.col("_j"))).filter(~F.coalesce(F.col("_pure") == F.col("_opure"), F.lit(False)))
    pairs = pairs.select(F.col("g").alias("_pg"), F.col("_c").alias("_i"), "_j")
    cols = ["g", "_i", "_j", "rep", "component", *extra]
    left = dealt.join(pairs, (F.col("g") == F.col("_pg")) & (F.col("_c") == F.col("_i"))).select(*cols)
    right = dealt.join(pairs.filter("_i <> _j"), (F.col("g") == F.col("_pg")) & (F.col("_c") == F.col("_j"))).select(*cols)
    return left.union(right)


def forest(hit: np.ndarray, reps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (a, b) that span the components of a symmetric matrix of links."""
    n = len(reps)
    hit = hit | np.eye(n, dtype=bool)
    least = np.arange(n)
    while True:
        now = np.where(hit, least[None, :], n).min(axis=1)
        now = now[now]
        if (now == least).all():
            break
        least = now
    b = np.flatnonzero(least != np.arange(n))
    return reps[least[b]], reps[b]
