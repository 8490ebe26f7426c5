"""Packing of token sequences into windows with little padding.

A document's tokens, with an end token, are cut into whole windows and a tail. Tails are counted by bin (``bin_tokens``
wide); every combination of at most ``depth`` bins that fills a window is a candidate pattern, and non-negative least
squares over the histogram says how often each is used. The repeat counts are rounded down to what the histogram
holds; tails left over are packed greedily in a stream that fills window after window, cutting a tail where a window
is full, and the last, part-filled window is cut into parts whose lengths are powers of two, which need no padding.

The histogram has a fixed number of bins, so the solver's work does not grow with the input. Each row gets its rank in
its bin from a count by task made while its text was tokenized, ranks map to windows through the patterns' ranges, and
only windows of at most ``depth`` pieces are ever grouped.

Defined results: null and empty texts are the end token alone; repeated rows are packed each (their pieces share a
doc_id); a document of any length is cut into windows; an empty table gives an empty result; further columns are
dropped.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from lexiloom.llm.common import bounded_batches, buckets_for, held, running_start, slices, written
from lexiloom.llm.tokens import IdTokens, default_path

_CUT = pa.schema(
    [("doc_id", pa.int64()), ("part", pa.int32()), ("rank", pa.int64()), ("bin", pa.int32()), ("row", pa.int64()), ("start", pa.int64()),
     ("length", pa.int64()), ("crc", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())]
)
CUT_SCHEMA = "doc_id long, part int, rank long, bin int, row long, start long, length long, crc long, doc_tokens long, ids binary"


def cut_documents(docs: DataFrame, window: int, bin_tokens: int, end_id: int, tokenizer_path: str) -> DataFrame:
    """Whole windows (bin 0, numbered from 1) and tails (bin: tokens over ``bin_tokens``, rounded up), ranked by bin in a task.

    ``ids`` holds a tail's tokens, for the few that are cut later; whole windows keep theirs out of the table, as their
    checksum is final.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, part = held(f"ids {tokenizer_path}", lambda: IdTokens(tokenizer_path)), TaskContext.get().partitionId()
        ranks: dict[int, int] = {}
        row = 0
        end = int(end_id).to_bytes(4, "little")
        for b in slices(batches, 256):
            out: list[list] = [[] for _ in _CUT]
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                raw = t.text_ids(text or "") + end
                n, row = len(raw) // 4, row + 1
                for start in range(0, n, window):
                    length = min(window, n - start)
                    k = 0 if length == window else -(-length // bin_tokens)
                    rank = ranks[k] = ranks.get(k, -1) + 1
                    own = raw[4 * start : 4 * (start + length)]
                    for c, v in zip(out, (doc, part, rank, k, row, start, length, zlib.crc32(own), n, own if k else None)):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _CUT)], schema=_CUT)

    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(cut, CUT_SCHEMA)


def patterns(n_bins: int, depth: int) -> list[tuple[int, ...]]:
    """All combinations of at most ``depth`` bins, largest first, that sum to ``n_bins``."""
    out: list[tuple[int, ...]] = []

    def grow(had: tuple[int, ...], left: int) -> None:
        if left == 0:
            out.append(had)
        elif len(had) < depth:
            for b in range(min(left, had[-1] if had else n_bins), 0, -1):
                if b * (depth - len(had)) >= left:
                    grow((*had, b), left - b)

    grow((), n_bins)
    return out


def nnls(a: np.ndarray, y: np.ndarray, rounds: int) -> np.ndarray:
    """Non-negative least squares by the active-set method of Lawson and Hanson."""
    m = a.shape[1]
    gram, ay = a.T @ a, a.T @ y
    x, used = np.zeros(m), np.zeros(m, bool)
    for _ in range(rounds):
        w = ay - gram @ x
        w[used] = -np.inf
        j = int(np.argmax(w))
        if w[j] <= 1e-9 * max(1.0, np.abs(ay).max()):
            break
        used[j] = True
        while True:
            at = np.flatnonzero(used)
            s = np.linalg.lstsq(gram[np.ix_(at, at)], ay[at], rcond=None)[0]
            if s.min() > 0:
                x[:] = 0
                x[at] = s
                break
            neg = s <= 0
            step = np.min(x[at][neg] / np.maximum(x[at][neg] - s[neg], 1e-300))
            x[at] += step * (s - x[at])
            x[at[x[at] <= 1e-12]] = 0
            used = x > 0
            if not used.any():
                break
    return x


def solve(histogram: np.ndarray, depth: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns with repeat counts that the histogram (bin 1 first) can serve."""
    n = len(histogram)
    if not histogram.sum():
        return []
    options = patterns(n, depth)
    a = np.zeros((n, len(options)))
    for j, p in enumerate(options):
        for b in p:
            a[b - 1, j] += 1
    scale = float(histogram.max())
    # what a least-squares fit leaves of long tails costs more than what it leaves of short ones
    weight = np.sqrt(np.arange(1, n + 1) / n)
    x = nnls(a * weight[:, None], histogram / scale * weight, 4 * n) * scale
    left, out = histogram.astype(np.int64).copy(), []
    for j in np.argsort(-x):
        need = np.bincount(np.array(options[j]) - 1, minlength=n)
        on = need > 0
        times = int(min(np.floor(x[j] + 1e-6), (left[on] // need[on]).min()))
        if times > 0:
            left -= times * need
            out.append((options[j], times))
    for p in options:  # what rounding has left and still fills a window
        need = np.bincount(np.array(p) - 1, minlength=n)
        on = need > 0
        times = int((left[on] // need[on]).min())
        if times > 0:
            left -= times * need
            out.append((p, times))
    return out


PIECE_COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def pack(docs: DataFrame, *, window: int = 4096, depth: int = 3, bin_tokens: int = 32, end_id: int = 2, tokenizer_path: str | None = None) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    path = tokenizer_path or default_path()
    cut = written(cut_documents(docs, window, bin_tokens, end_id, path), "packing-cut")
    counts = written(cut.groupBy("bin", "part").count(), "packing-counts")
    n_bins = window // bin_tokens
    by_bin = {r[0]: r[1] for r in counts.groupBy("bin").agg(F.sum("count")).collect()}  # n_bins + 1 rows at most
    plan = solve(np.array([by_bin.get(b, 0) for b in range(1, n_bins + 1)]), depth)

    # ranges of ranks by bin: (bin, first, times, sequence of the first, slot); at most 4 * n_bins * depth rows
    ranges, sequence, served = [], by_bin.get(0, 0), dict.fromkeys(range(n_bins + 1), 0)
    ranges.append((0, 0, by_bin.get(0, 0), 0, 0))
    for p, times in plan:
        for slot, b in enumerate(p):
            ranges.append((b, served[b], times, sequence, slot))
            served[b] += times
        sequence += times
    before = W.partitionBy("bin").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("bin", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    ranked = cut.join(starts, ["bin", "part"]).withColumn("rank", F.col("base") + F.col("rank"))
    limit = F.element_at(F.array(*[F.lit(int(served[b]) if b else int(by_bin.get(0, 0))) for b in range(n_bins + 1)]), F.col("bin") + 1)
    table = spark.createDataFrame(ranges, "rbin int, first long, times long, seq long, slot int")
    on = (F.col("bin") == F.col("rbin")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("times"))
    placed = ranked.filter(F.col("rank") < limit).drop("ids").join(F.broadcast(table), on)
    placed = placed.withColumn("sequence_id", F.col("seq") + F.col("rank") - F.col("first"))
    at = F.sum("length").over(W.partitionBy("sequence_id").orderBy("slot").rowsBetween(W.unboundedPreceding, -1))
    # whole windows stand alone: they need no grouping
    whole = placed.filter("bin = 0").withColumn("offset", F.lit(0).cast("long"))
    grouped = placed.filter("bin > 0").withColumn("offset", F.coalesce(at, F.lit(0)).cast("long"))
    placed = whole.unionByName(grouped)

    n_rest = sum(by_bin.values()) - sum(served.values()) - by_bin.get(0, 0)
    done = placed.select("doc_id", "start", "length", F.col("crc").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
    if not n_rest:
        return done
    rest = ranked.filter(F.col("rank") >= limit)
    rest = running_start(rest, [], ["bin", "part", "rank"], "length", "at", buckets_for(n_rest, 2000, 1))
    total = rest.select("length").agg(F.sum("length")).first()[0]
    return done.unionByName(_stream(rest, window, sequence, int(total)))


def stream_bounds(begin: int, end: int, window: int, total: int) -> list[tuple[int, int, int]]:
    """The parts of [begin, end) in a stream of ``total`` tokens: (from, sequence, offset there). Whole windows, then
    for the rest of the stream one sequence for each power of two in it, the largest first."""
    out, x = [], begin
    whole = total // window
    while x < end and x // window < whole:
        out.append((x, x // window, x % window))
        x = (x // window + 1) * window
    if x < end:
        at, seq, left = whole * window, whole, total % window
        while left:
            size = 1 << (left.bit_length() - 1)
            lo = max(x, at)
            if lo < min(end, at + size):
                out.append((lo, seq, lo - at))
            at, seq, left = at + size, seq + 1, left - size
    return out


def _stream(rest: DataFrame, window: int, first_sequence: int, total: int) -> DataFrame:
    """Pieces of left-over tails, laid end to end; a tail over a border is cut there."""
    types = T.StructType([T.StructField(c, T.LongType()) for c in PIECE_COLUMNS])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list[int]] = [[] for _ in PIECE_COLUMNS]
            for doc, start, length, crc, tokens, at, ids in zip(*[c.to_pylist() for c in b.columns]):
                parts = stream_bounds(at, at + length, window, total)
                for (lo, seq, offset), hi in zip(parts, [*[p[0] for p in parts[1:]], at + length]):
                    own = crc if hi - lo == length else zlib.crc32(ids[4 * (lo - at) : 4 * (hi - at)])
                    for c, v in zip(out, (doc, start + lo - at, hi - lo, own, tokens, first_sequence + seq, offset)):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=PIECE_COLUMNS)

    return rest.select("doc_id", "start", "length", "crc", "doc_tokens", "at", "ids").mapInArrow(cut, types)
