"""Near-duplicate embeddings by sorted projection passes.

In each pass a vector gets a key of concatenated one-bit hashes (signs of random projections) and the vectors of a label
are ordered by key; each is compared with the ``window`` before it, and links are united: in a task by union-find (so that a task hands on a
spanning forest and not its pairs), across tasks and passes by large-star and small-star. Only keys are sorted; their order
is numbered and dealt in runs that repeat the ``window`` rows before them, so no border between tasks cuts a window, and
the runs fetch their vectors. A label of at most ``window`` vectors is compared whole in one pass. For larger ones the
number of passes follows from the size, so that a pair at the threshold, in an even spread, shares the leading bits of its
label in some pass but for a chance of ``miss``. Where more vectors share these bits than a window holds, those that still
lie in different components are compared each with each, in blocks of bounded size: the chance does not depend on how dense
a region is, but the work there grows with the square of its size. Components found, links are counted
exactly: vectors of a component are compared in blocks of bounded size, which hand on counts and not pairs (a component of
k vectors is repeated k / ``block`` times for it).

Passes compare in single precision, whose error is bounded; what lies within the bound of the threshold is compared
again in double precision, and what lies within 1e-9 by adding products in order, as the definition is written.

Vectors with equal components and label are one class from the start. Defined results: a vector that is null, zero, or
holds null or non-finite components, or whose label is null, links with nothing and is its own component; vectors of
different lengths do not link; repeated rows each count as a vector, and rows that share a vec_id are one node: a row has
the links of its own vector and the component of the node; ties in a key are ordered by vec_id; further columns, whatever
their names, are dropped; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.common import bounded_batches, buckets_for, groups, in_order, map_groups, running_start, slices, written
from lexiloom.llm.components import components, cross_blocks, forest

RUN = 8192
BITS = 48
CLOSE = 1e-9


def bits_for(n: float, window: int) -> int:
    """Leading bits that leave about half a window of n vectors in an even spread; none where a window holds all."""
    return 0 if n <= window else min(BITS, math.ceil(math.log2(2.0 * n / window)))


def passes_for(n: int, window: int, cosine: float, miss: float) -> int:
    """Passes so that a pair at ``cosine`` (an angle told apart by a random plane in that share) keeps its bits in one."""
    same = (1 - math.acos(cosine) / math.pi) ** bits_for(n, window)
    return 1 if same == 1 else max(2, math.ceil(math.log(miss) / math.log(1 - same)))


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label, x (doubles) of what can link."""
    x = F.col("embedding").cast("array<double>")
    rows = vectors.select("vec_id", F.col("label").cast("long").alias("label"), x.alias("x")).filter("label is not null and x is not null and vec_id is not null")
    return rows.filter(_fine(F.col("x")))


def _fine(x):
    return F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0), F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows scaled by a power of two, which changes no digit and keeps squares finite."""
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def units(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def ordered_cosine(x: np.ndarray, y: np.ndarray) -> float:
    """Cosine of two rows, products added one after the other."""
    dot = xx = yy = 0.0
    for a, b in zip(x.tolist(), y.tolist()):
        dot += a * b
        xx += a * a
        yy += b * b
    return dot / (math.sqrt(xx) * math.sqrt(yy))


def hits(x: np.ndarray, y: np.ndarray, cosine: float) -> np.ndarray:
    """Which rows of two matrices (as ``matrix`` gives them) link."""
    c = units(x) @ units(y).T
    out = c >= cosine
    for i, j in zip(*np.nonzero(np.abs(c - cosine) <= CLOSE)):
        out[i, j] = ordered_cosine(x[i], y[j]) >= cosine
    return out


def _keyed(classes: DataFrame, most: int, window: int, cosine: float, miss: float, seed: int) -> DataFrame:
    """A row per class and pass: pass, label, dim, key, prefix, rep. Labels have as many passes as their size asks for."""
    planes: dict[int, np.ndarray] = {}
    passes = passes_for(most, window, cosine, miss)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)
        for b in slices(batches, 1024):
            dims, sizes = b.column(2).to_numpy(zero_copy_only=False), b.column(4).to_numpy(zero_copy_only=False)
            for d, n in sorted(set(zip(dims.tolist(), sizes.tolist()))):
                part = b.take(pa.array(np.flatnonzero((dims == d) & (sizes == n))))
                if d not in planes:
                    planes[d] = np.random.default_rng([seed, d]).standard_normal((passes * BITS, d))
                own, bits = passes_for(n, window, cosine, miss), bits_for(n, window)
                x = matrix(part.column(3))
                k = part.num_rows
                for p in range(own):
                    key = ((x @ planes[d][p * BITS : (p + 1) * BITS].T > 0) * powers).sum(axis=1)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(k, p), pa.int32()), part.column(1), pa.array(np.full(k, d), pa.int32()), pa.array(key, pa.int64()), pa.array(key >> (BITS - bits), pa.int64()), part.column(0)],
                        names=["pass", "label", "dim", "key", "prefix", "rep"],
                    )

    sizes = classes.groupBy(F.col("label").alias("_label"), F.size("x").alias("_dim")).agg(F.count("*").alias("_n"))
    rows = classes.withColumn("dim", F.size("x")).join(sizes, (F.col("label") == F.col("_label")) & (F.col("dim") == F.col("_dim")))
    return rows.select("rep", "label", "dim", "x", "_n").mapInArrow(keys, "pass int, label long, dim int, key long, prefix long, rep long")


def _single(classes: DataFrame) -> DataFrame:
    """_r, _l, _d, x: rep, label, length and the unit vector in single precision."""

    def scale(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1024):
            dims = b.column(2).to_numpy(zero_copy_only=False)
            for d in sorted(set(dims.tolist())):
                part = b.take(pa.array(np.flatnonzero(dims == d)))
                x = units(matrix(part.column(3))).astype(np.float32).reshape(-1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(x) + 1, d, dtype=np.int32)), pa.array(x))
                yield pa.RecordBatch.from_arrays([*part.columns[:3], lists], names=["_r", "_l", "_d", "x"])

    return classes.select("rep", "label", F.size("x").alias("d"), "x").mapInArrow(scale, "_r long, _l long, _d int, x array<float>")


def _window_links(runs: DataFrame, window: int, cosine: float) -> DataFrame:
    """a, b, sure: of each run, a spanning forest of the sure links between neighbours, and the pairs that single
    precision cannot decide. ``runs``: (run, pos, pass, label, dim, rep, x), x in single precision."""

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, 1):
            t = t.combine_chunks()
            group = np.stack([t.column(c).to_numpy() for c in ("pass", "label", "dim")])
            cuts = [0, *(np.flatnonzero((group[:, 1:] != group[:, :-1]).any(axis=0)) + 1).tolist(), t.num_rows]
            reps = t.column("rep").to_numpy()
            parent: dict[int, int] = {}

            def root(i: int) -> int:
                while (p := parent.get(i, i)) != i:
                    parent[i] = parent.get(p, p)
                    i = p
                return i

            out: list[tuple[int, int, bool]] = []
            for lo, hi in zip(cuts, cuts[1:]):
                column = t.column("x").slice(lo, hi - lo).combine_chunks()
                x = column.flatten().to_numpy(zero_copy_only=False).reshape(hi - lo, -1)
                error = 4e-7 * (x.shape[1] + 4)
                r = reps[lo:hi]
                for at in range(0, len(r), 256):
                    first = max(0, at - window)
                    c = x[at : at + 256] @ x[first : at + 256].T
                    for i, j in zip(*np.nonzero(c >= cosine - error)):
                        a, b = int(i) + at, int(j) + first
                        if b < a <= b + window and (p := root(int(r[a]))) != (q := root(int(r[b]))):
                            sure = bool(c[i, j] >= cosine + error)
                            if sure:
                                parent[max(p, q)] = min(p, q)
                            out.append((int(r[b]), int(r[a]), sure))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.bool_()))], names=["a", "b", "sure"])

    return runs.repartition("run").sortWithinPartitions("run", "pos").mapInArrow(links, "a long, b long, sure boolean")


def _checked(pairs: DataFrame, classes: DataFrame, cosine: float) -> DataFrame:
    """Of pairs (label, dim, a, b), those that link in double precision."""
    pick = lambda k: classes.select(F.col("rep").alias(f"_{k}"), F.col("label").alias(f"_l{k}"), F.col("x").alias(f"x{k}"))
    both = pairs.join(pick("i"), F.col("a") == F.col("_i")).join(pick("j"), (F.col("b") == F.col("_j")) & (F.col("_li") == F.col("_lj"))).filter(F.size("xi") == F.size("xj"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [bool(hits(matrix(b.column(2).slice(i, 1)), matrix(b.column(3).slice(i, 1)), cosine)[0, 0]) for i in range(b.num_rows)]
            k = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(k), b.column(1).filter(k)], names=["a", "b"])

    return both.select("a", "b", "xi", "xj").mapInArrow(check, "a long, b long")


def _range_links(numbered: DataFrame, node: DataFrame, classes: DataFrame, window: int, cosine: float, block: int) -> DataFrame | None:
    """Links (a, b) between components, of ranges of a key prefix that are larger than a window; None without any."""
    by = ("pass", "label", "dim", "prefix")
    member = numbered.join(node, F.col("rep") == F.col("node"), "left").select(*by, "rep", F.coalesce("component", "rep").alias("component"))
    ranges = member.groupBy(*by).agg(F.count("*").alias("_k"), F.min("component").alias("_lo"), F.max("component").alias("_hi"))
    ranges = ranges.filter((F.col("_k") > window) & (F.col("_lo") < F.col("_hi"))).select(*[F.col(c).alias(f"_{c}") for c in by])
    ranges = written(ranges.withColumn("g", F.monotonically_increasing_id()), "embedding-ranges")
    if ranges.isEmpty():
        return None
    on = [F.col(c) == F.col(f"_{c}") for c in by]
    open_ = member.join(ranges, on).select("g", "rep", "component", F.lit(1).alias("weight"), F.col("label").alias("own"), F.col("dim").alias("width"))
    blocks = cross_blocks(written(open_, "embedding-open"), block)

    def compare(t: pa.Table) -> pa.RecordBatch | None:
        x = matrix(t.column("x").combine_chunks())
        a, b = forest(hits(x, x, cosine), t.column("rep").to_numpy())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    x = classes.select(F.col("rep").alias("_r"), F.col("label").alias("_l"), F.size("x").alias("_d"), "x")
    rows = blocks.join(x, (F.col("rep") == F.col("_r")) & (F.col("own") == F.col("_l")) & (F.col("width") == F.col("_d"))).select("g", "_i", "_j", "rep", "x")
    return map_groups(rows, ["g", "_i", "_j"], compare, "a long, b long").distinct()


def _count(members: DataFrame, cosine: float, block: int) -> DataFrame:
    """rep, label, n: how many vectors (copies counted) of its component a class links with, itself left out."""
    n = members.count()
    sizes = members.groupBy(F.col("component").alias("_c")).agg(F.count("*").alias("_k"))
    placed = running_start(members.withColumn("_one", F.lit(1).cast("long")), ["component"], ["rep", "label", "dim"], "_one", "_at", buckets_for(n, 2000))
    placed = placed.join(sizes, F.col("component") == F.col("_c"))
    chunk, chunks = F.floor(F.col("_at") / block), F.ceil(F.col("_k") / block)
    placed = placed.withColumn("_own", chunk.cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), (chunks - 1).cast("int"))))
    placed = placed.withColumn("_i", F.least("_own", "_other")).withColumn("_j", F.greatest("_own", "_other"))

    def count(t: pa.Table) -> pa.RecordBatch | None:
        t = t.combine_chunks()
        own, rep, mult, label, dim = (t.column(c).to_numpy() for c in ("_own", "rep", "mult", "label", "dim"))
        i, j = t.column("_i")[0].as_py(), t.column("_j")[0].as_py()
        reps, labels, sums = [], [], []
        for key in set(zip(label.tolist(), dim.tolist())):
            at = np.flatnonzero((label == key[0]) & (dim == key[1]))
            x = matrix(t.column("x").take(pa.array(at)).combine_chunks())
            m = mult[at].astype(np.float64)
            if i == j:
                hit = hits(x, x, cosine)
                np.fill_diagonal(hit, True)
                parts = [(at, hit @ m - 1)]
            else:
                left, right = own[at] == i, own[at] == j
                hit = hits(x[left], x[right], cosine)
                parts = [(at[left], hit @ m[right]), (at[right], hit.T @ m[left])]
            for where, s in parts:
                reps.append(rep[where])
                labels.append(label[where])
                sums.append(s)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(reps), pa.int64()), pa.array(np.concatenate(labels), pa.int64()), pa.array(np.concatenate(sums).astype(np.int64))], names=["rep", "label", "n"])

    rows = placed.select("component", "_i", "_j", "_own", "rep", "label", "dim", "mult", "x")
    out = map_groups(rows, ["component", "_i", "_j"], count, "rep long, label long, n long")
    return out.groupBy("rep", "label").agg(F.sum("n").alias("n"))


def embedding_components(vectors: DataFrame, *, cosine: float = 0.93, window: int = 1024, miss: float = 1e-4, block: int = 256, seed: int = 3) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of (vec_id, embedding, label)."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    digits = F.concat_ws(",", F.transform("x", lambda v: (v + F.lit(0.0)).cast("string")))
    rows = written(usable(vectors).withColumn("_h", F.sha2(digits, 256)), "embedding-rows")
    classes = rows.groupBy("label", "_h").agg(F.min("vec_id").alias("rep"), F.count("*").alias("mult"), F.first("x").alias("x"))
    classes = written(classes, "embedding-classes")
    most = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    keyed = _keyed(classes, int(most), window, cosine, miss, seed)
    numbered = written(in_order(keyed, ["pass", "label", "dim", "key", "rep"], "pos", {}), "embedding-numbered")
    # a run of rows, and before it the window that the rows before it leave
    run = F.floor(F.col("pos") / RUN)
    runs = numbered.withColumn("run", F.explode(F.when(F.pmod("pos", F.lit(RUN)) >= RUN - window, F.array(run, run + 1)).otherwise(F.array(run))))
    x = _single(classes)
    runs = runs.join(x, (F.col("rep") == F.col("_r")) & (F.col("label") == F.col("_l")) & (F.col("dim") == F.col("_d"))).select("run", "pos", "pass", "label", "dim", "rep", "x")
    near = written(_window_links(runs, window, cosine), "embedding-near")
    links = near.filter("sure").select("a", "b").distinct()
    doubtful = near.filter("not sure").select("a", "b").distinct()
    links = links.union(_checked(doubtful, classes, cosine))
    # a vec_id with several vectors is one node of each of their classes
    several = rows.groupBy("vec_id").agg(F.min(F.struct("label", "_h")).alias("_lo"), F.max(F.struct("label", "_h")).alias("_hi")).filter("_lo <> _hi").select(F.col("vec_id").alias("_v"))
    same = rows.select("vec_id", "label", "_h").join(several, F.col("vec_id") == F.col("_v")).join(classes.select(F.col("label").alias("_l"), F.col("_h").alias("_k"), "rep"), (F.col("label") == F.col("_l")) & (F.col("_h") == F.col("_k")))
    links = written(links.union(same.filter("rep <> vec_id").select("rep", "vec_id")), "embedding-links")
    node = components(links)
    more = _range_links(numbered, node, classes, window, cosine, block)
    if more is not None:
        node = components(links.union(written(more, "embedding-links")))
    node = written(node, "embedding-components")
    members = classes.join(node, F.col("rep") == F.col("node")).select("component", "rep", "label", F.size("x").alias("dim"), "mult", "x")
    counts = _count(written(members, "embedding-members"), cosine, block)
    of_class = (
        classes.select("label", "_h", "rep", "mult")
        .join(node, F.col("rep") == F.col("node"), "left")
        .join(counts.select(F.col("rep").alias("_rep"), F.col("label").alias("_lab"), "n"), (F.col("rep") == F.col("_rep")) & (F.col("label") == F.col("_lab")), "left")
        .select("label", "_h", "rep", "mult", F.coalesce("n", F.col("mult") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    of_class = written(of_class, "embedding-result")
    single = of_class.filter("mult = 1").select(F.col("rep").alias("vec_id"), "n_links", "component_id")
    many = of_class.filter("mult > 1").select(F.col("label").alias("_label"), F.col("_h").alias("_key"), "n_links", "component_id", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("_salt"))
    own = rows.select("vec_id", "label", "_h", F.pmod(F.xxhash64("vec_id"), F.lit(8)).cast("int").alias("_s"))
    copies = own.join(many, (F.col("label") == F.col("_label")) & (F.col("_h") == F.col("_key")) & (F.col("_s") == F.col("_salt"))).select("vec_id", "n_links", "component_id")
    x = F.col("embedding").cast("array<double>")
    fine = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & _fine(x)
    others = vectors.filter(~F.coalesce(fine, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = single.unionByName(copies).unionByName(others)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
