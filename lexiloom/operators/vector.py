"""Exact nearest vectors by cosine, for one question or many, in matrix products of bounded size and double precision.

Empty and zero vectors, and vectors of another length than the question's, have similarity 0, which a threshold of 0
keeps. A null is no vector: such rows are not searched, and such questions find nothing.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.functions.text import contextual_text
from lexiloom.operators.lexical import top_k
from lexiloom.sources.store import Versioned, bounded_batches, staged


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays as an expression; 0 for empty, zero or unequally long ones."""
    a, b = a.cast("array<double>"), b.cast("array<double>")
    add = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    dot = add(F.zip_with(a, b, lambda x, y: x * y))
    norms = F.sqrt(add(F.transform(a, lambda x: x * x))) * F.sqrt(add(F.transform(b, lambda x: x * x)))
    fine = (F.size(a) == F.size(b)) & (norms > 0)
    return F.coalesce(F.when(fine, dot / norms), F.lit(0.0))


def unit_rows(ids: np.ndarray, lists: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: ids and unit rows (zero rows and empty ones stay zero; null lists are left out)."""
    out = {}
    sizes = np.array([-1 if s is None else s for s in pa.compute.list_value_length(lists).to_pylist()])
    for d in set(sizes.tolist()) - {-1}:
        at = np.flatnonzero(sizes == d)
        m = np.nan_to_num(lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(at), d))
        norm = np.sqrt((m * m).sum(1, keepdims=True))
        out[d] = ids[at], np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)
    return out


#: Rows of tops that a task may keep where all questions go to every task.
KEPT_ROWS = 4_000_000


class _Best:
    """The best ``k`` vectors of each question so far: by score, then by the smaller id. Products are made in tiles of about
    ``cells`` numbers, and of a tile only what may belong to the best is kept, so memory does not grow with questions times
    vectors."""

    def __init__(self, questions: dict[int, tuple[np.ndarray, np.ndarray]], k: int, threshold: float, cells: int = 1 << 20):
        self.questions, self.k, self.cells = questions, k, cells
        self.ids = np.concatenate([ids for ids, _ in questions.values()]) if questions else np.zeros(0, np.int64)
        # score and id of the last of a question's best, once there are k
        self.least, self.last = np.full(len(self.ids), threshold, float), np.full(len(self.ids), np.iinfo(np.int64).max)
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.n_found, self.full = 0, max(cells, 2 * k * len(self.ids))

    def add(self, ids: np.ndarray, lists: pa.Array) -> None:
        vectors, first = unit_rows(ids, lists), 0
        for d, (_, q) in self.questions.items():
            if d in vectors:
                self._add(first, q, *vectors[d])
            # vectors of another length than the question's have similarity 0
            others = [v for own, (v, _) in vectors.items() if own != d]
            if others:
                v = np.sort(np.concatenate(others))[: self.k]
                self._add(first, np.zeros((len(q), 0)), v, np.zeros((len(v), 0)))
            first += len(q)

    def _add(self, first: int, q: np.ndarray, v: np.ndarray, m: np.ndarray) -> None:
        step, n = max(1, self.cells // max(1, len(v))), len(v)
        for lo in range(0, len(q), step):
            s = q[lo : lo + step] @ m.T
            # scores are rounded to 6 digits below: a little less may still be as good
            least = self.least[first + lo : first + lo + len(s)]
            fine = s >= (least - 1.1e-6)[:, None]
            if n > self.k and np.count_nonzero(fine) > 4 * self.k * len(s):
                fine = s >= np.maximum(least, np.partition(s, n - self.k, axis=1)[:, n - self.k])[:, None] - 1.1e-6
            i, j = np.nonzero(fine)
            row, ids, score = i + (first + lo), v[j], np.round(s[i, j], 6) + 0.0
            fine = (score > self.least[row]) | (score == self.least[row]) & (ids <= self.last[row])
            if fine.any():
                self.found.append((row[fine], ids[fine], score[fine]))
                self.n_found += len(self.found[-1][0])
                if self.n_found > self.full:
                    self.cut()

    def cut(self) -> None:
        row, ids, score = (np.concatenate(x) for x in zip(*self.found))
        order = np.lexsort((ids, -score, row))
        row, ids, score = row[order], ids[order], score[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        last, kept = rank == self.k - 1, rank < self.k
        self.least[row[last]], self.last[row[last]] = score[last], ids[last]
        self.found, self.n_found = [(row[kept], ids[kept], score[kept])], int(kept.sum())

    def rows(self, most: int = 50_000) -> Iterator[pa.RecordBatch]:
        if self.found:
            self.cut()
            row, ids, score = self.found[0]
            for i in range(0, len(row), most):
                cut = slice(i, i + most)
                yield pa.RecordBatch.from_arrays([pa.array(self.ids[row[cut]], pa.int64()), pa.array(ids[cut], pa.int64()), pa.array(score[cut], pa.float64())], schema=FOUND)


FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def nearest(vectors: DataFrame, questions: DataFrame, k: int = 10, threshold: float = 0.0, sent_bytes: int = 64 << 20, chunk: int = 8192, block: int = 256) -> DataFrame:
    """query_id, vec_id, score, rank. ``vectors``: (vec_id, embedding); ``questions``: (query_id, embedding).

    Similarities below ``threshold`` (0 drops what points away) are left out. Questions of at most ``sent_bytes`` go to
    every task if their tops are of at most ``KEPT_ROWS`` rows, and vectors are read where they are; each task hands on
    ``k`` rows for each question. More questions are dealt to blocks, and each pair of a block and a chunk of vectors meets
    in a task.
    """
    bounded_batches(vectors.sparkSession)
    x = lambda c: c.cast("array<double>").alias("x")
    asked = questions.select(F.col("query_id").cast("long").alias("id"), x(F.col("embedding"))).filter("x is not null")
    held = vectors.select(F.col("vec_id").cast("long").alias("id"), x(F.col("embedding"))).filter("x is not null")
    m, size = asked.agg(F.count("*"), F.coalesce(F.sum(F.size("x") * 8 + 64), F.lit(0))).first()
    schema = "query_id long, vec_id long, score double"
    if size <= sent_bytes and m * k <= KEPT_ROWS:
        rows = asked.toArrow()
        q = unit_rows(rows.column("id").to_numpy(), rows.column("x").combine_chunks())
        sent = vectors.sparkSession.sparkContext.broadcast(q)

        def scan(batches):
            best = _Best(sent.value, k, threshold)
            for b in batches:
                best.add(b.column(0).to_numpy(zero_copy_only=False), b.column(1))
            yield from best.rows()

        return top_k(held.mapInArrow(scan, schema), ["query_id"], k, "vec_id")
    n = held.count()
    chunks, blocks = max(1, -(-n // chunk)), max(1, -(-m // block))
    grid = lambda upto: F.explode(F.sequence(F.lit(0), F.lit(upto - 1)))
    v = held.select("id", "x", F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("int").alias("c"), grid(blocks).alias("b"))
    q = asked.select("id", "x", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("b"), grid(chunks).alias("c"))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        best = _Best(unit_rows(right.column("id").to_numpy(), right.column("x").combine_chunks()) if right.num_rows else {}, k, threshold)
        if left.num_rows:
            best.add(left.column("id").to_numpy(), left.column("x").combine_chunks())
        return pa.Table.from_batches(list(best.rows()), FOUND)

    part = v.groupBy("c", "b").cogroup(q.groupBy("c", "b")).applyInArrow(meet, schema)
    return top_k(part, ["query_id"], k, "vec_id")


def nearest_text(vectors: DataFrame, questions: DataFrame, embedder, k: int = 10, threshold: float = 0.0) -> DataFrame:
    """As ``nearest`` for questions (query_id, text), embedded first."""
    if embedder is None:
        raise ValueError("searching by text needs an embedder")
    return nearest(vectors, embed(questions, embedder, "query_id", "text").withColumnRenamed("id", "query_id"), k, threshold)


def embed(rows: DataFrame, embedder, key: str, text: str, batch: int = 100, delay: float = 0.0, failing: str = "raise") -> DataFrame:
    """key as id, embedding: texts are embedded in batches inside the partitions.

    A failing batch raises its task's error; with ``failing="skip"`` its rows get a null, and after an answer of 429 the rest of
    the partition too, so that a backfill run again takes them up.
    """

    def run(batches):
        stopped = False
        for b in batches:
            for i in range(0, b.num_rows, batch):
                part = b.slice(i, batch)
                if stopped:
                    vecs = [None] * part.num_rows
                else:
                    try:
                        vecs = embedder.embed(part.column(1).to_pylist())
                    except Exception as e:
                        if failing != "skip":
                            raise
                        vecs, stopped = [None] * part.num_rows, getattr(e, "status", None) == 429
                    if delay:
                        time.sleep(delay)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(vecs, pa.list_(pa.float32()))], names=["id", "embedding"])

    return rows.select(F.col(key).cast("long").alias("id"), F.coalesce(text, F.lit("")).alias("text")).mapInArrow(run, "id long, embedding array<float>")


def embedding_counts(embedded: DataFrame) -> DataFrame:
    """One row: total, embedded, failed of what ``embed`` gives."""
    return embedded.agg(F.count("*").alias("total"), F.count("embedding").alias("embedded"), (F.count("*") - F.count("embedding")).alias("failed"))


class VectorIndex:
    """Vectors kept as a table beside the signature of what they were read from: ``fresh`` tells whether that has changed."""

    def __init__(self, spark: SparkSession, root: str):
        self.vectors, self.mark = Versioned(spark, f"{root}/vectors"), Versioned(spark, f"{root}/signature")

    def build(self, source: DataFrame, most: int | None = None) -> DataFrame:
        rows = source.filter("embedding is not null").select("vec_id", "embedding")
        out = self.vectors.write(rows if most is None else first_vectors(rows, most))
        self.mark.write(signature(source))
        return out

    def load(self) -> DataFrame | None:
        return self.vectors.read()

    def fresh(self, source: DataFrame) -> bool:
        kept = self.mark.read()
        return kept is not None and kept.first()[0] == signature(source).first()[0]

    def get(self, source: DataFrame) -> DataFrame:
        """The kept vectors if they are fresh, else newly built ones."""
        return self.load() if self.fresh(source) else self.build(source)

    def add(self, rows: DataFrame) -> DataFrame:
        """With (vec_id, embedding) rows in place of those of their ids."""
        rows = rows.select("vec_id", "embedding")
        had = self.load()
        return self.vectors.write(staged(rows if had is None else had.join(rows.select("vec_id"), "vec_id", "left_anti").unionByName(rows), "vectors"))

    def remove(self, ids: DataFrame) -> DataFrame | None:
        had = self.load()
        return None if had is None else self.vectors.write(staged(had.join(ids.select("vec_id").distinct(), "vec_id", "left_anti"), "vectors"))

    def clear(self) -> None:
        had = self.load()
        if had is not None:
            self.vectors.write(had.limit(0))


def first_vectors(vectors: DataFrame, most: int) -> DataFrame:
    """An index limited to its first ``most`` vectors, in order of their ids."""
    return vectors.orderBy("vec_id").limit(most)


def signature(vectors: DataFrame) -> DataFrame:
    """One row: signature. It changes when vectors are added, removed or changed in place."""
    row = F.xxhash64("vec_id", "embedding").cast("decimal(20,0)")
    return vectors.agg(F.count("embedding").alias("n"), F.max("vec_id").alias("last"), F.sum(row).alias("h")).select(F.sha2(F.concat_ws(":", F.col("n").cast("string"), F.col("last").cast("string"), F.col("h").cast("string")), 256).alias("signature"))


def memory_estimate(vectors: DataFrame, limit: int | None = None) -> DataFrame:
    """One row: embeddings, dimension, megabytes (8 bytes a component and 100 a row), is_limited."""
    dim = F.coalesce(F.max(F.size("embedding")), F.lit(0))
    n = F.count("embedding")
    rows = vectors.agg(n.alias("n"), dim.alias("dimension"))
    held = F.least("n", F.lit(limit)) if limit else F.col("n")
    return rows.select(held.alias("embeddings"), "dimension", F.round(held * (F.col("dimension") * 8 + 100) / 1048576, 2).alias("megabytes"), F.lit(limit is not None).alias("is_limited"))


def missing_embeddings(chunks: DataFrame, vectors: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of ``chunks`` without a vector: what a backfill has to embed; running it again resumes."""
    have = vectors.filter("embedding is not null").select(F.col("vec_id").alias("_v"))
    return chunks.join(have, F.col(key) == F.col("_v"), "left_anti")


def backfill(chunks: DataFrame, vectors: DataFrame, embedder, key: str = "doc_id") -> DataFrame:
    """vec_id, embedding of the missing rows, each with its own document's title and section."""
    todo = missing_embeddings(chunks, vectors, key)
    text = contextual_text(F.col("content"), F.col("heading_path"), F.col("title"))
    return embed(todo.select(key, text.alias("text")), embedder, key, "text").withColumnRenamed("id", "vec_id")
