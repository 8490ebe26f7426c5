"""Near-duplicate documents by MinHash: many universal hash minima, banding, verification, connected components.

A document is the set of its distinct runs of five words. Documents with the same set are one class from the start
(they are joined to their smallest doc_id and never compared). Each class has ``bands * rows`` minima of universal
hashes and a bucket for each band. First the classes of a bucket are compared with its smallest member: by signature,
then on full sets. The links found are joined into components by large-star and small-star. Then all classes of a bucket
that still lie in different components are compared with each other, in blocks of bounded size: by signature, where a pair
counts in the first of its common buckets only, and, of the classes that have a likely partner there, on full sets. A
block hands on a spanning forest of its links, never its pairs. So components are those of all links within buckets, at
every size of a bucket. Missed is what banding misses, (1 - s ** rows) ** bands of the pairs at similarity s, and a pair
whose signatures agree in ``SLACK`` less than the threshold (for 120 minima, one in a million of those at it).

Buckets whose classes link cost work in proportion to their size; the classes of a bucket that do not link are compared
each with each. Defined results: null and empty texts, and texts without words, have size 0 and link with nothing; a text of
fewer than five words is one run; rows that share a doc_id are one node (linked if any of their texts links), each with the
size of its own set; rows without a doc_id take their class's smallest doc_id as component, or none; texts of any length
are taken whole; an empty table gives an empty one; further columns, whatever their names, are dropped by
``near_duplicates`` and kept by ``keep_first``, which keeps one row of each kept doc_id (the first by a hash of its columns)
and every row without a doc_id.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lexiloom.llm.common import bounded_batches, held, map_groups, slices, written
from lexiloom.llm.components import components, cross_blocks, forest

_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Signatures of a pair that is compared agree in a share of at least the threshold less this.
SLACK = 0.16
SALTS = 8


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(text: str | None) -> list[str]:
    low = (text or "").translate(_UPPER) if not (text or "").isascii() else (text or "").lower()
    return _WORDS.findall(low)


class Shingler:
    """Sets of 64-bit hashes of a text's runs of ``width`` words; keeps the hashes of the first words it sees."""

    LIMIT = 120_000

    def __init__(self, width: int = 5):
        self.width, self.seen = width, {}

    def word_hash(self, w: str) -> int:
        h = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
        if len(self.seen) < self.LIMIT and len(w) < 64:
            self.seen[w] = h
        return h

    def of(self, text: str | None) -> np.ndarray:
        """Sorted and distinct."""
        words = words_of(text)
        if not words:
            return np.zeros(0, np.uint64)
        known = list(map(self.seen.get, words))
        if None in known:
            known = [h if h is not None else self.word_hash(w) for h, w in zip(known, words)]
        h = np.array(known, np.uint64)
        n = max(1, len(h) - self.width + 1)
        out = np.full(n, min(len(h), self.width), np.uint64)
        for i in range(min(self.width, len(h))):
            out = _mix(out * _ODD + h[i : i + n])
        return np.unique(out)


def shingle_hashes(text: str | None, width: int = 5) -> np.ndarray:
    return Shingler(width).of(text)


def _shingler(width: int) -> Shingler:
    return held(f"shingles {width}", lambda: Shingler(width))


class Minima:
    """Universal hashes of 32 bits: the high half of a * x + b, modulo 2 ** 64, a odd."""

    def __init__(self, k: int, seed: int):
        r = np.random.default_rng(seed)
        self.a = r.integers(0, 1 << 63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = r.integers(0, 1 << 63, k, dtype=np.uint64)

    def of(self, x: np.ndarray) -> np.ndarray:
        best = np.full(len(self.a), np.iinfo(np.uint64).max, np.uint64)
        for i in range(0, len(x), 1024):
            part = x[i : i + 1024]
            np.minimum(best, (self.a[:, None] * part[None, :] + self.b[:, None]).min(axis=1), out=best)
        return (best >> np.uint64(32)).astype(np.uint32)


def signatures(docs: DataFrame, bands: int, rows: int, width: int, seed: int) -> DataFrame:
    """doc_id, n_shingles, set_key (128 bits of the whole set; null if empty), signature, buckets (a hash by band)."""
    bounded_batches(docs.sparkSession)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, shingler = Minima(bands * rows, seed), _shingler(width)
        mult = np.random.default_rng(seed + 1).integers(0, 1 << 63, (bands, rows), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        for b in slices(batches, 256):
            n, keys, sigs, hashes = [], [], [], []
            for text in b.column(1).to_pylist():
                x = shingler.of(text)
                n.append(len(x))
                if len(x):
                    sig = m.of(x)
                    keys.append(xxhash.xxh3_128_digest(x.tobytes()))
                    sigs.append(sig.tobytes())
                    mixed = _mix((sig.reshape(bands, rows).astype(np.uint64) + np.uint64(1)) * mult)
                    hashes.append(_mix(mixed.sum(axis=1) + np.arange(bands, dtype=np.uint64) * _ODD).astype(np.int64))
                else:
                    keys.append(None)
                    sigs.append(None)
                    hashes.append(None)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary()), pa.array(hashes, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "set_key", "signature", "buckets"],
            )

    return docs.select("doc_id", "text").mapInArrow(sign, "doc_id long, n_shingles long, set_key binary, signature binary, buckets array<long>")


def _rows_of(column: pa.Array, kind: type, n: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(n, -1)


def _likely(pairs: DataFrame, sigs: DataFrame, least: float) -> DataFrame:
    """Pairs whose signatures agree in at least a share ``least`` of places."""
    left = sigs.select(F.col("rep").alias("_i"), F.col("signature").alias("sa"))
    right = sigs.select(F.col("rep").alias("_j"), F.col("signature").alias("sb"))
    both = pairs.join(left, F.col("a") == F.col("_i")).join(right, F.col("b") == F.col("_j")).select("a", "b", "sa", "sb")

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (_rows_of(c, np.uint32, b.num_rows) for c in (b.column(2), b.column(3)))
                keep = pa.array((x == y).mean(axis=1) >= least)
                yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], names=["a", "b"])

    return both.mapInArrow(agree, "a long, b long")


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int, width: int) -> DataFrame:
    """Pairs (a, b) whose full sets meet: 100 * intersection >= percent * union. Each pair fetches its two texts; only
    documents that are in a pair travel."""
    need = pairs.select(F.col("a").alias("_n")).union(pairs.select("b")).distinct()
    t = written(texts.join(need, F.col("doc_id") == F.col("_n"), "left_semi").select("doc_id", "text"), "near-dup-texts")
    both = (
        pairs.join(t.select(F.col("doc_id").alias("_i"), F.col("text").alias("ta")), F.col("a") == F.col("_i"))
        .join(t.select(F.col("doc_id").alias("_j"), F.col("text").alias("tb")), F.col("b") == F.col("_j"))
        .select("a", "b", "ta", "tb")
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, last = _shingler(width), {}

        def of(text: str) -> np.ndarray:
            if text not in last:
                if len(last) > 64:
                    last.clear()
                last[text] = shingler.of(text)
            return last[text]

        for b in slices(batches, 128):
            keep = []
            for ta, tb in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                x, y = of(ta), of(tb)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            k = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(k), b.column(1).filter(k)], names=["a", "b"])

    return both.mapInArrow(compare, "a long, b long")


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many hashes each two sets share."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(x) for x in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    several = count > 1  # a hash of one set only is shared with none
    number = np.cumsum(several) - 1
    kept = several[column]
    owner, column = owner[kept], number[column[kept]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((n, n))
    width = 4096
    for lo in range(0, int(several.sum()), width):
        first, last = np.searchsorted(column, [lo, lo + width])
        m = np.zeros((n, min(width, int(several.sum()) - lo)), np.float32)
        m[owner[first:last], column[first:last] - lo] = 1
        out += m @ m.T
    return out


def likely_members(blocks: DataFrame, sigs: DataFrame, least: float) -> DataFrame:
    """Of the members (g, _i, _j, rep, component, band) of each block, those that have a likely partner in another
    component with which they share no earlier band."""
    rows = blocks.join(sigs.select(F.col("rep").alias("_r"), "signature", "buckets"), F.col("rep") == F.col("_r"))

    def mark(t: pa.Table) -> pa.RecordBatch | None:
        t = t.combine_chunks()
        n, band = t.num_rows, t.column("band")[0].as_py()
        comp = t.column("component").to_numpy()
        sig = _rows_of(t.column("signature"), np.uint32, n)
        before = t.column("buckets").combine_chunks().flatten().to_numpy().reshape(n, -1)[:, :band]
        some = np.zeros(n, bool)
        for at in range(0, n, 32):
            near = (sig[at : at + 32, None] == sig[None]).mean(axis=2) >= least
            near &= comp[at : at + 32, None] != comp[None]
            if band and near.any():
                i, j = np.nonzero(near)
                near[i, j] = ~(before[at + i] == before[j]).any(axis=1)
            some |= near.any(axis=0)
            some[at : at + 32] |= near.any(axis=1)
        if not some.any():
            return None
        keep = pa.array(some)
        return pa.RecordBatch.from_arrays([t.column(c).combine_chunks().filter(keep) for c in ("g", "_i", "_j", "rep")], names=["g", "_i", "_j", "rep"])

    cols = ["g", "_i", "_j", "rep", "component", "band", "signature", "buckets"]
    return map_groups(rows.select(*cols), ["g", "_i", "_j"], mark, "g long, _i long, _j long, rep long")


def block_links(blocks: DataFrame, texts: DataFrame, percent: int, width: int) -> DataFrame:
    """A spanning forest (a, b) of the links within each block (g, _i, _j), on full sets."""
    t = texts.select(F.col("doc_id").alias("_t"), "text")

    def compare(t: pa.Table) -> pa.RecordBatch | None:
        shingler = _shingler(width)
        sets = [shingler.of(x) for x in t.column("text").to_pylist()]
        size = np.array([len(x) for x in sets], np.float64)
        both = shared_counts(sets)
        a, b = forest(100 * both >= percent * (size[:, None] + size[None, :] - both), t.column("rep").to_numpy())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    rows = blocks.join(t, F.col("rep") == F.col("_t")).select("g", "_i", "_j", "rep", "text")
    return map_groups(rows, ["g", "_i", "_j"], compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, *, percent: int = 85, bands: int = 20, rows: int = 6, width: int = 5, seed: int = 5, block: int = 512) -> DataFrame:
    """doc_id, n_shingles, component_id, kept."""
    least = percent / 100 - SLACK
    own = written(signatures(docs, bands, rows, width, seed), "near-dup-signatures")
    # a class of equal sets: its smallest doc_id stands for it
    one = F.min(F.struct("doc_id", "signature", "buckets", "n_shingles"))
    classes = own.filter("set_key is not null and doc_id is not null").groupBy("set_key").agg(one.alias("_o"), F.count("*").alias("k"))
    reps = written(classes.select("set_key", "k", F.col("_o.doc_id").alias("rep"), "_o.signature", "_o.buckets", "_o.n_shingles"), "near-dup-classes")
    texts = docs.select("doc_id", "text").filter("doc_id is not null")
    # only buckets that several classes share
    rows_ = reps.select("rep", "n_shingles", F.posexplode("buckets").alias("band", "bucket"))
    shared = rows_.groupBy("bucket").agg(F.count("*").alias("_k"), F.min("rep").alias("first")).filter("_k > 1").withColumnRenamed("bucket", "_b")
    buckets = written(rows_.join(shared, F.col("bucket") == F.col("_b")).select("bucket", "band", "rep", "first", "n_shingles"), "near-dup-buckets")
    star = buckets.filter("rep <> first").select(F.col("first").alias("a"), F.col("rep").alias("b")).distinct()
    links = confirmed(written(_likely(star, reps, least), "near-dup-pairs"), texts, percent, width)
    # a doc_id with several sets is one node
    several = own.filter("set_key is not null and doc_id is not null").groupBy("doc_id").agg(F.min("set_key").alias("_lo"), F.max("set_key").alias("_hi")).filter("_lo <> _hi").select(F.col("doc_id").alias("_d"))
    same = own.join(several, F.col("doc_id") == F.col("_d")).select("doc_id", "set_key").join(reps.select(F.col("set_key").alias("_key"), "rep"), F.col("set_key") == F.col("_key"))
    links = written(links.union(same.filter("rep <> doc_id").select("rep", "doc_id")), "near-dup-links")
    node = components(links)
    # all that still lies in different components of a bucket
    at = buckets.join(node, F.col("rep") == F.col("node"), "left").select("bucket", "band", "rep", F.coalesce("component", "rep").alias("component"), "n_shingles")
    split = at.groupBy("bucket").agg(F.min("component").alias("_lo"), F.max("component").alias("_hi"), F.count("*").alias("_k"))
    split = split.filter((F.col("_lo") < F.col("_hi")) & (F.col("_k") > 2)).select(F.col("bucket").alias("_b"))
    weight = 1 + F.floor(F.col("n_shingles") / 1000)
    open_ = written(at.join(split, F.col("bucket") == F.col("_b")).select(F.col("bucket").alias("g"), "rep", "component", "band", weight.alias("weight")), "near-dup-open")
    if not open_.isEmpty():
        marked = written(likely_members(cross_blocks(open_, block), reps, least), "near-dup-marked")
        need = texts.join(marked.select(F.col("rep").alias("_n")).distinct(), F.col("doc_id") == F.col("_n"), "left_semi")
        found = written(block_links(marked, written(need, "near-dup-texts"), percent, width), "near-dup-links")
        if not found.isEmpty():
            node = components(links.union(found))
    # classes take their representative's component; members of a class of several find it by the set's key
    of_class = reps.join(node, F.col("rep") == F.col("node"), "left").select("set_key", "k", "rep", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    of_class = written(of_class, "near-dup-components")
    single = of_class.filter("k = 1").select(F.col("rep").alias("doc_id"), "n_shingles", "component_id")
    many = of_class.filter("k > 1").select(F.col("set_key").alias("_key"), "component_id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    members = own.filter("set_key is not null and doc_id is not null").withColumn("_own", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    copies = members.join(many, (F.col("set_key") == F.col("_key")) & (F.col("_own") == F.col("_salt"))).select("doc_id", "n_shingles", "component_id")
    empty = own.filter("set_key is null and doc_id is not null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    nameless = own.filter("doc_id is null").join(of_class.select(F.col("set_key").alias("_key"), "component_id"), F.col("set_key") == F.col("_key"), "left").select("doc_id", "n_shingles", "component_id")
    out = single.union(copies).union(empty).union(nameless)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """The documents, all columns, that stand for their component, one row of each doc_id."""
    found = written(near_duplicates(docs, **options), "near-dup-result")
    kept = found.filter("kept and doc_id is not null").groupBy("doc_id").count()
    once = kept.select(F.col("doc_id").alias("_kept"))
    nameless = docs.filter(docs["doc_id"].isNull())
    out = docs.join(once, docs["doc_id"] == once["_kept"], "left_semi")
    twice = kept.filter("count > 1").select(F.col("doc_id").alias("_twice"))
    if twice.isEmpty():
        return out.union(nameless)
    names = docs.columns
    again = out.join(twice, out["doc_id"] == twice["_twice"], "left_semi").select([F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    order = W.partitionBy(f"c{names.index('doc_id')}").orderBy(F.xxhash64(*again.columns))
    again = again.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n").toDF(*names)
    return out.join(twice, out["doc_id"] == twice["_twice"], "left_anti").union(again).union(nameless)
