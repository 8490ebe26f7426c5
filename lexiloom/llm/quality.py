"""Quality of documents by regularised quadratic discriminant analysis of transformed text statistics.

A text gives ``FEATURES`` statistics (shares of kinds of characters, lengths and repetition of words and lines), made
nearly normal by logarithms. For each class the mean and covariance over all labelled rows are kept; a covariance is
shrunk towards the pooled one and that towards its diagonal. A score is the logistic of the difference of the two
log densities (squared Mahalanobis distances by triangular solves with the cached Cholesky factors, and the factors'
log determinants) and of the class shares, tempered.

Statistics are made once per text and kept in a narrow table; moments are sums over it, so labelled rows are never
gathered. Defined results: null and empty texts have statistics of their own (all counts 0) and are scored like others;
a label that is null, or a document without one, teaches nothing; of several labels of a document each counts; if a
class is missing among the labels, every score is the other class (0 or 1), and 0.5 without any labels; equal texts have
equal scores; a row without a doc_id is scored, but cannot be taught by and is not held out; texts of any length are taken
whole; an empty table gives an empty one; further columns, whatever their names, are dropped by ``quality_scores`` and kept
by ``keep_good``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.common import bounded_batches, slices, written

FEATURES = (
    "words", "mean_word", "upper", "digit", "symbol", "comma_stop", "odd_punct", "bar", "lines", "line_words", "repeated_lines", "repeated_words", "top_word",
    "sentence_words", "short_words", "non_ascii", "repeated_fours", "symbol_words", "space", "long_words",
)
N = len(FEATURES)
_BYTE = np.zeros(256, np.int64)
for _c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ":
    _BYTE[_c] = 1
for _c in b"0123456789":
    _BYTE[_c] = 2
for _c in b"#$%&*+<=>@\\^_`{}~[]()/":
    _BYTE[_c] = 3
for _c in b".,":
    _BYTE[_c] = 4
for _c in b"!?;:\"'-":
    _BYTE[_c] = 5
_BYTE[ord("|")] = 6
_BYTE[10] = 7
_BYTE[[9, 11, 12, 13, 32]] = 8
_BYTE[128:] = 9
_MARKS = re.compile(r"[#$%&*|!?<>{}=]")


def statistics(text: str | None) -> np.ndarray:
    """The transformed statistics of one text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    kinds = np.bincount(_BYTE, weights=np.bincount(np.frombuffer(raw, np.uint8), minlength=256), minlength=10)
    n = max(1.0, float(len(raw)))
    words = (text or "").lower().split()
    w = max(1, len(words))
    counts: dict[str, int] = {}
    for x in words:
        counts[x] = counts.get(x, 0) + 1
    lines = [x for x in (text or "").split("\n") if x.strip()]
    k = max(1, len(lines))
    fours = list(zip(words, words[1:], words[2:], words[3:]))
    letters = len(raw) - kinds[8] - kinds[7]
    return np.array(
        [
            np.log1p(len(words)),
            np.log1p(letters / w),
            np.log(0.002 + kinds[1] / n),
            np.log(0.002 + kinds[2] / n),
            np.log(0.002 + kinds[3] / n),
            np.log(0.002 + kinds[4] / w),
            np.log(0.002 + kinds[5] / n),
            np.log(0.002 + kinds[6] / n),
            np.log1p(len(lines)),
            np.log1p(len(words) / k),
            np.log(0.01 + 1 - len(set(lines)) / k),
            np.log(0.01 + 1 - len(counts) / w),
            np.log(0.01 + max(counts.values(), default=0) / w),
            np.log1p(len(words) / max(1.0, kinds[4])),
            np.log(0.01 + sum(map((3).__gt__, map(len, words))) / w),
            np.log(0.002 + kinds[9] / n),
            np.log(0.01 + 1 - len(set(fours)) / max(1, len(fours))),
            np.log(0.01 + len(_MARKS.findall(text or "")) / w),
            np.log(0.01 + kinds[8] / n),
            np.log(0.01 + sum(map((14).__lt__, map(len, words))) / w),
        ]
    )


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and x, the transformed statistics, of every whole text."""
    bounded_batches(docs.sparkSession)

    def stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 512):
            x = np.array([statistics(t) for t in b.column(1).to_pylist()]).reshape(-1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(x) + 1, N, dtype=np.int32)), pa.array(x))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], names=["doc_id", "x"])

    return docs.select("doc_id", "text").mapInArrow(stats, "doc_id long, x array<double>")


def forward_solve(low: np.ndarray, b: np.ndarray) -> np.ndarray:
    """y with low @ y = b, for a lower triangular matrix and many columns at once."""
    y = np.empty_like(b)
    for i in range(len(low)):
        y[i] = (b[i] - low[i, :i] @ y[:i]) / low[i, i]
    return y


@dataclass
class Discriminant:
    """What scoring needs: by class the mean, the Cholesky factor, its log determinant; log odds of the classes."""

    centre: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    factors: np.ndarray
    logdets: np.ndarray
    odds: float
    temper: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.centre) / self.scale, -8, 8)
        log = []
        for k in (0, 1):
            y = forward_solve(self.factors[k], (z - self.means[k]).T)
            log.append(-0.5 * (y * y).sum(0) - 0.5 * self.logdets[k])
        t = np.clip((log[1] - log[0]) * self.temper + self.odds, -40, 40)
        return 1 / (1 + np.exp(-t))


def moments(rows: DataFrame, label: str) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Count, sum and sum of products by class (0, 1): sums by partition, then by class; 2 rows come to the driver."""
    width = N + N * N

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, 1 + width))
        for b in batches:
            y = b.column(0).to_numpy(zero_copy_only=False).astype(int)
            x = b.column(1).values.to_numpy(zero_copy_only=False).reshape(-1, N)
            for k in (0, 1):
                own = x[y == k]
                sums[k] += np.concatenate([[len(own)], own.sum(0), (own.T @ own).reshape(-1)])
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat([0, 1], 1 + width), pa.int32()), pa.array(np.tile(np.arange(1 + width), 2), pa.int32()), pa.array(sums.reshape(-1))], names=["y", "i", "v"])

    got = rows.select(F.col(label).cast("int").alias("y"), "x").mapInArrow(add, "y int, i int, v double").groupBy("y", "i").agg(F.sum("v").alias("v")).collect()
    out = {}
    for k in (0, 1):
        v = np.zeros(1 + width)
        for r in got:
            if r["y"] == k:
                v[r["i"]] = r["v"]
        out[k] = (v[0], v[1 : N + 1], v[N + 1 :].reshape(N, N))
    return out


def fit(rows: DataFrame, label: str = "y", *, pooled: float = 0.2, diagonal: float = 0.05, temper: float = 0.5) -> Discriminant | float:
    """The discriminant of rows (x, label 0 or 1); a constant score if a class is missing."""
    m = moments(rows.filter(F.col(label).isin(0, 1)), label)
    n = {k: m[k][0] for k in m}
    if n[0] < 2 or n[1] < 2:
        return 0.5 if n[0] == n[1] == 0 else float(n[1] / (n[0] + n[1]))
    total = n[0] + n[1]
    centre = (m[0][1] + m[1][1]) / total
    var = np.diag(m[0][2] + m[1][2]) / total - centre**2
    scale = np.sqrt(np.maximum(var, 1e-6))
    means, covs = [], []
    for k in (0, 1):
        mu = m[k][1] / n[k]
        covs.append((m[k][2] / n[k] - np.outer(mu, mu)) / np.outer(scale, scale))
        means.append((mu - centre) / scale)
    joint = (n[0] * covs[0] + n[1] * covs[1]) / total
    factors, dets = [], []
    for k in (0, 1):
        a = max(pooled, N / (n[k] + N))  # few rows say little of a covariance
        c = (1 - a) * covs[k] + a * joint
        c = (1 - diagonal) * c + diagonal * (np.diag(np.diag(c)) + 0.05 * np.eye(N))
        low = np.linalg.cholesky(c)
        factors.append(low)
        dets.append(2 * np.log(np.diag(low)).sum())
    return Discriminant(centre, scale, np.array(means), np.array(factors), np.array(dets), float(np.log(n[1] / n[0])), temper)


def teaching(labels: DataFrame, modulus: int, held_out: int) -> DataFrame:
    """Labels of the rows that may teach: crc32 of the doc_id as text, modulo ``modulus``, is not ``held_out``."""
    return labels.filter(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(modulus)) != held_out)


def scored(rows: DataFrame, model: Discriminant | float) -> DataFrame:
    """doc_id, score for rows (doc_id, x)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1).values.to_numpy(zero_copy_only=False).reshape(-1, N) if b.num_rows else np.zeros((0, N))
            s = model.scores(x) if isinstance(model, Discriminant) else np.full(len(x), model)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s)], names=["doc_id", "score"])

    return rows.select("doc_id", "x").mapInArrow(run, "doc_id long, score double")


def known_labels(labels: DataFrame, label: str, modulus: int, held_out: int) -> DataFrame:
    return teaching(labels, modulus, held_out).select(F.col("doc_id").alias("_doc"), F.col(label).alias("y")).filter("y is not null")


def trained(stats: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int) -> Discriminant | float:
    known = known_labels(labels, label, modulus, held_out)
    return fit(stats.join(known, F.col("doc_id") == F.col("_doc")).select("x", "y"))


def quality_scores(docs: DataFrame, labels: DataFrame, *, modulus: int = 3, held_out: int = 1) -> DataFrame:
    """doc_id, score (0 to 1, higher: good) of every document."""
    stats = written(document_statistics(docs), "quality-statistics")
    return scored(stats, trained(stats, labels, "quality", modulus, held_out))


def keep_good(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.5, modulus: int = 3, held_out: int = 1, max_rows: int = 200_000) -> DataFrame:
    """The documents, all columns, whose score reaches ``threshold``. At most about ``max_rows`` labelled rows teach (dealt by
    a hash of doc_id), so their ids can go to every worker and only their texts are read for it."""
    known = known_labels(labels, "quality", modulus, held_out)
    share = max_rows / max(1, known.count())
    if share < 1:
        known = known.filter(F.pmod(F.xxhash64("_doc"), F.lit(1 << 30)) < int(0.97 * share * (1 << 30)))
    taught = docs.select("doc_id", "text").join(F.broadcast(known.select(F.col("_doc").alias("_id")).distinct()), F.col("doc_id") == F.col("_id"), "left_semi")
    model = fit(document_statistics(taught).join(known, F.col("doc_id") == F.col("_doc")).select("x", "y"))
    return docs.filter(score_column(model)(F.col("text")) >= threshold)


def score_column(model: Discriminant | float):
    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        if not isinstance(model, Discriminant):
            return pd.Series(np.full(len(texts), model))
        if not len(texts):
            return pd.Series([], dtype=float)
        return pd.Series(model.scores(np.array([statistics(t) for t in texts])))

    return score
