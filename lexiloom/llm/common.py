"""What the operators of this package share: written tables that cut lineage, row keys and distributed running sums."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import TypeVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: A word, as every contract of this package counts them.
WORD = r"[^\x20\x09-\x0D]+"

T = TypeVar("T")
_swept: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset, a folder of this machine, if all of Spark runs on it."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="lexiloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def _sweep(spark: SparkSession, root: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(root)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone at exit; the folder's owner then expires it
        pass


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: later reads need no lost executor's work, and prune columns.

    The tables of an application lie in one folder, removed when its driver exits.
    """
    spark = df.sparkSession
    root = f"{shared_dir(spark).rstrip('/')}/lexiloom-{spark.sparkContext.applicationId}"
    if root not in _swept:
        _swept.add(root)
        atexit.register(_sweep, spark, root)
    path = f"{root}/{tag}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def bounded_batches(spark: SparkSession) -> None:
    """Batches for Python workers end at 1 MB, whatever the rows' lengths; the same bound for every operator, as plans
    are lazy and a session's setting holds for all of them."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(1 << 20))


def slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``rows`` rows, for work that holds several times what it reads."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.Table]:
    """Of batches in order of their first ``n_keys`` columns, a table for each run of equal keys (no nulls in them)."""
    parts: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        keys = [b.column(i).to_numpy(zero_copy_only=False) for i in range(n_keys)]
        change = np.zeros(b.num_rows - 1, bool)
        for k in keys:
            change |= k[1:] != k[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), b.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            key = tuple(k[lo] for k in keys)
            if parts and key != last:
                yield pa.Table.from_batches(parts)
                parts = []
            parts.append(b.slice(lo, hi - lo))
            last = key
    if parts:
        yield pa.Table.from_batches(parts)


def map_groups(df: DataFrame, keys: list[str], make: Callable[[pa.Table], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``make`` of the rows of each key (columns in front, no nulls). Many small groups share a task and its batches; a
    group is held whole, so its size must be bounded by how keys are dealt."""
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, len(keys)):
            out = make(t)
            if out is not None and out.num_rows:
                yield out

    rest = [c for c in df.columns if c not in keys]
    return df.select(*keys, *rest).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


_held: list = [None, None]


def held(kind: str, make: Callable[[], T]) -> T:
    """What a Python worker keeps from task to task (a tokenizer, a cache). It keeps one kind at a time: the tables of one
    operator go when another asks for its own, so stages do not add up."""
    if _held[0] != kind:
        _held[:] = [None, None]
        _held[:] = [kind, make()]
    return _held[1]


def buckets_for(n_rows: int, per_bucket: int = 20_000, least: int = 64) -> int:
    return max(least, -(-n_rows // per_bucket))


def running_start(df: DataFrame, group: list[str], order: list[str], value: str, out: str, n_buckets: int, facts: DataFrame | None = None) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows before each row of its group; and the columns of ``facts``, which
    has a row for each group.

    Rows of a group are dealt to ``n_buckets`` hash buckets of the ``order`` columns; sums of the buckets are added up
    over (group, bucket) rows, and a window runs inside a bucket only. A group with a third of all rows is thus spread
    evenly. The order is (bucket, *order); rows that tie in all of ``order`` must be alike.
    """
    b = F.pmod(F.xxhash64(F.lit(7), *[F.col(c) for c in order]), F.lit(n_buckets))
    keyed = df.withColumn("_b", b)
    sums = keyed.groupBy(*group, "_b").agg(F.sum(value).alias("_s"))
    over = W.partitionBy(*group) if group else W.partitionBy(F.lit(0))
    before = F.coalesce(F.sum("_s").over(over.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(*[F.col(c).alias(f"_g_{c}") for c in group], F.col("_b").alias("_gb"), before.alias("_before"))
    if facts is not None:
        same = F.lit(True)
        for c in group:
            same = same & F.col(f"_g_{c}").eqNullSafe(F.col(c))
        sums = sums.join(facts, same).drop(*group)
    on = F.col("_b") == F.col("_gb")
    for c in group:
        on = on & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    inner = F.coalesce(
        F.sum(value).over(W.partitionBy(*group, "_b").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
    )
    return (
        keyed.withColumn("_in", inner)
        .join(sums, on)
        .withColumn(out, F.col("_before") + F.col("_in"))
        .drop("_b", "_gb", "_before", "_in", *[f"_g_{c}" for c in group])
    )


def in_order(df: DataFrame, order: list, number: str, sums: dict[str, str]) -> DataFrame:
    """Adds ``number`` (from 0) in a global order, and for each (out, value) of ``sums`` the sum over the rows before.

    Rows are range-partitioned and sorted where they are; a row per task carries the totals before it. Rows that tie in
    the whole order get their numbers by chance.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = written(placed, "in-order").withColumn("_part", F.shiftright("_at", 33))
    totals = placed.groupBy(F.col("_part").alias("_p")).agg(F.count("*").alias("_k"), *[F.sum(v).alias(f"_t_{o}") for o, v in sums.items()])
    earlier = W.partitionBy(F.lit(0)).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select("_p", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_b{c}") for c in ("_k", *[f"_t_{o}" for o in sums])])
    inside = W.partitionBy("_part").orderBy("_at").rowsBetween(W.unboundedPreceding, -1)
    if sums:
        placed = placed.withColumns({f"_in_{o}": F.coalesce(F.sum(v).over(inside), F.lit(0)) for o, v in sums.items()})
    # a row per task: bounded
    out = placed.join(F.broadcast(totals), F.col("_part") == F.col("_p"))
    out = out.withColumns({number: F.col("_b_k") + F.col("_at") - F.shiftleft("_part", 33), **{o: F.col(f"_b_t_{o}") + F.col(f"_in_{o}") for o in sums}})
    return out.select(*df.columns, number, *sums)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))
