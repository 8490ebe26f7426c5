"""Tables: reading, staging in the shared folder, versions with an atomic pointer, CSV and JSON sinks."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_swept: set[str] = set()


def bounded_batches(spark: SparkSession) -> None:
    """Batches for Python workers end at 1 MB, whatever the rows' lengths, so that what a worker holds does not grow with
    the rows of its partition. A session's setting holds for all its plans."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(1 << 20))


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{root}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset, a folder of this machine, if all of Spark runs on it."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="lexiloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def _file_system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _sweep(spark: SparkSession, root: str) -> None:
    try:
        p, fs = _file_system(spark, root)
        fs.delete(p, True)
    except Exception:  # the session may be gone at exit; the folder's owner then expires it
        pass


def staging_path(spark: SparkSession, tag: str) -> str:
    """A new folder in the shared one. The tables of an application lie in one folder, removed when its driver exits."""
    root = f"{shared_dir(spark).rstrip('/')}/lexiloom-{spark.sparkContext.applicationId}"
    if root not in _swept:
        _swept.add(root)
        atexit.register(_sweep, spark, root)
    return f"{root}/{tag}-{uuid.uuid4().hex}"


def staged(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: later reads need no lost executor's work, and prune columns."""
    spark, path = df.sparkSession, staging_path(df.sparkSession, tag)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


class Versioned:
    """A table as version folders and numbered pointer files. A pointer is created, never overwritten, once its version is
    whole; readers take the largest number. So a reader sees a whole version at every moment, a writer that dies leaves the
    old one, and of two writers with the same number one fails. The last ``keep`` versions stay for readers that have
    begun with them."""

    def __init__(self, spark: SparkSession, root: str, keep: int = 2):
        self.spark, self.root, self.keep = spark, root.rstrip("/"), keep

    def _pointers(self) -> list[tuple[int, str]]:
        p, fs = _file_system(self.spark, self.root)
        if not fs.exists(p):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(p)]
        return sorted((int(n.removeprefix("CURRENT-")), n) for n in names if n.startswith("CURRENT-"))

    def _paths(self, pointer: str) -> list[str]:
        return [r[0] for r in self.spark.read.text(f"{self.root}/{pointer}").collect() if r[0]]

    def current(self) -> list[str] | None:
        """The folders that the table consists of; None before the first version."""
        found = self._pointers()
        return self._paths(found[-1][1]) if found else None

    def read(self) -> DataFrame | None:
        paths = self.current()
        return None if paths is None else self.spark.read.parquet(*[f"{self.root}/{p}" for p in paths])

    def point_to(self, paths: list[str]) -> None:
        """Makes these folders the table, and drops pointers and folders that no kept version needs."""
        before = self._pointers()
        number = before[-1][0] + 1 if before else 1
        target, fs = _file_system(self.spark, f"{self.root}/CURRENT-{number:012d}")
        temp, _ = _file_system(self.spark, f"{self.root}/.CURRENT-{uuid.uuid4().hex}")
        out = fs.create(temp, False)
        out.write(bytearray("\n".join(paths).encode()))
        out.close()
        if fs.exists(target) or not fs.rename(temp, target):
            fs.delete(temp, False)
            raise RuntimeError(f"another writer has made version {number} of {self.root}")
        kept = {p.split("/")[0] for _, n in before[1 - self.keep :] for p in self._paths(n)} if self.keep > 1 else set()
        kept |= {p.split("/")[0] for p in paths}
        for _, n in before[: len(before) + 1 - self.keep]:
            for p in self._paths(n):
                if p.split("/")[0] not in kept:
                    fs.delete(_file_system(self.spark, f"{self.root}/{p.split('/')[0]}")[0], True)
            fs.delete(_file_system(self.spark, f"{self.root}/{n}")[0], False)

    def write(self, df: DataFrame) -> DataFrame:
        version = f"v-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{version}")
        self.point_to([version])
        return self.spark.read.parquet(f"{self.root}/{version}")


class Bucketed(Versioned):
    """A versioned table in hash buckets of a key; a new version writes the buckets it touches and points to the others
    where they are."""

    def __init__(self, spark: SparkSession, root: str, key: str, buckets: int = 64, keep: int = 2):
        super().__init__(spark, root, keep)
        self.key, self.buckets = key, buckets

    def bucket(self, key: str | None = None):
        return F.pmod(F.xxhash64(key or self.key), F.lit(self.buckets)).cast("int")

    def touched(self, rows: DataFrame) -> set[int]:
        """The buckets of rows with the key: ``buckets`` numbers at most."""
        return {r[0] for r in rows.select(self.bucket()).distinct().collect()}

    def read_buckets(self, numbers: set[int]) -> DataFrame | None:
        paths = [p for p in self.current() or [] if int(p.rpartition("=")[2]) in numbers]
        return self.spark.read.parquet(*[f"{self.root}/{p}" for p in paths]) if paths else None

    def write_buckets(self, df: DataFrame, numbers: set[int]) -> None:
        """``df`` takes the place of all rows of the buckets ``numbers``."""
        version = f"v-{uuid.uuid4().hex}"
        df.withColumn("_bucket", self.bucket()).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.root}/{version}")
        p, fs = _file_system(self.spark, f"{self.root}/{version}")
        made = [f"{version}/{f.getPath().getName()}" for f in fs.listStatus(p) if "=" in f.getPath().getName()]
        self.point_to([p for p in self.current() or [] if int(p.rpartition("=")[2]) not in numbers] + made)


def export_log_csv(log: DataFrame, path: str, limit: int | None = None) -> int:
    """The query log as CSV with a header, newest first; the number of rows. An empty log makes no file."""
    rows = log.orderBy(F.desc("timestamp"), F.desc("id"))
    rows = rows.limit(limit) if limit else rows
    n = rows.count()
    if n:
        nested = [c for c, t in rows.dtypes if t.startswith(("array", "map", "struct"))]
        rows.withColumns({c: F.to_json(c) for c in nested}).write.mode("overwrite").option("header", True).csv(path)
    return n


def result_json(results: DataFrame) -> DataFrame:
    """Ranked results as JSON lines: chunk_id, score, content, heading_path, url."""
    return results.select(F.to_json(F.struct(F.col("doc_id").alias("chunk_id"), F.round("score", 4).alias("score"), "content", "heading_path", F.col("page_url").alias("url"))).alias("value"))


def export_graph_json(entities: DataFrame, edges: DataFrame, path: str) -> tuple[int, int]:
    """Entities and edges as JSON lines under ``path``; how many of each."""
    entities.write.mode("overwrite").json(f"{path}/entities")
    edges.write.mode("overwrite").json(f"{path}/relationships")
    return entities.count(), edges.count()


class PageCache:
    """Fetched pages, by the hash of their url: (url_hash, url, content, status_code)."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.table = Bucketed(spark, root, "url_hash", buckets)

    def _keyed(self, urls: DataFrame) -> DataFrame:
        return urls.withColumn("url_hash", F.sha2("url", 256))

    def get(self, urls: DataFrame) -> DataFrame:
        """The rows of (url) that the cache holds whole."""
        held = self.table.read()
        keyed = self._keyed(urls.select("url"))
        if held is None:
            return keyed.select("url", F.lit(None).cast("string").alias("content"), F.lit(None).cast("int").alias("status_code")).limit(0)
        return keyed.join(_whole(held).select("url_hash", "content", "status_code"), "url_hash").select("url", "content", "status_code")

    def misses(self, urls: DataFrame) -> DataFrame:
        held = self.table.read()
        return urls if held is None else cache_misses(urls, _whole(held)).select(*urls.columns)

    def put(self, pages: DataFrame) -> None:
        """Of (url, content, status_code): the last in order of a url's content stays; damaged rows of its bucket go."""
        rows = self._keyed(pages).groupBy("url_hash").agg(F.max(F.struct("url", "content", "status_code")).alias("_p")).select("url_hash", "_p.*")
        rows = staged(rows, "page-cache")
        numbers = self.table.touched(rows)
        if not numbers:
            return
        old = self.table.read_buckets(numbers)
        if old is not None:
            rows = _whole(old).join(rows.select("url_hash"), "url_hash", "left_anti").select(*rows.columns).unionByName(rows)
        self.table.write_buckets(rows, numbers)


def _whole(held: DataFrame) -> DataFrame:
    """Cache rows without a part, or under another url's hash, count as absent."""
    return held.filter("url is not null and content is not null and status_code is not null and url_hash = sha2(url, 256)")


def cache_misses(urls: DataFrame, cache: DataFrame) -> DataFrame:
    """Of (url), what a page cache (url_hash, content) does not hold."""
    keyed = urls.withColumn("url_hash", F.sha2("url", 256))
    return keyed.join(cache.filter("content is not null").select("url_hash"), "url_hash", "left_anti")
