"""Toxicity by a learned lexicon, Levenshtein automata and context windows.

The lexicon is learned from labelled rows: words, and stems (prefixes) that stand for many word forms, which are far
more frequent in toxic documents and stand in varied company there (a word that comes only with copies of one document
always follows the same word). It is kept as a trie. Each distinct word of a text becomes an automaton that accepts
what lies within one edit, run along the trie, which finds exact and misspelled terms in one walk. Each hit is weighed
by its term's log odds, for exact and misspelled forms apart, and by its context: within quotation marks or near a verb
of reporting it counts less, near a second person it counts more. The sum goes through a fitted logistic curve.

The fit uses at most ``max_rows`` labelled rows (dealt by a hash of doc_id), so the lexicon, the curve and all that is
sent to workers are bounded; scoring covers every whole text. Defined results: null and empty texts have no hit and get
the curve's value there; null labels teach nothing; without labels of both classes every score is the class that is
there (0 or 1), or 0 without any; equal texts have equal scores and repeated rows are scored each; of terms that tie in
how often they stand in toxic documents, the first by letters come first among the ``max_terms`` (1,000) that a lexicon may
have (none of the tables at hand comes near it); of terms that match a word with equally few edits, the earlier counts;
a row without a doc_id is scored and not held out; an empty table gives an empty one; further columns, whatever their names,
are dropped by ``toxicity_scores`` and kept by ``keep_civil``.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.common import bounded_batches, slices, written
from lexiloom.llm.quality import teaching

WORDS = re.compile(r"[^\W_]+")
REPORTING = {"said", "says", "called", "calls", "wrote", "writes", "term", "word", "words", "quote", "quoted", "quotes", "sagte", "wort", "nannte", "dit", "mot", "appelé", "dijo", "palabra", "llamó"}
SECOND = {"you", "your", "yours", "youre", "u", "du", "dich", "dein", "ihr", "tu", "toi", "vous", "usted", "ustedes", "tú", "te"}
_QUOTES = re.compile(r"[\"“”„«»]")
QUOTED, PERSONAL = 0.35, 1.25
SHORTEST_MISSPELLED = 5


class Trie:
    """Terms as nested dictionaries; a node's own terms under ''. A stem also matches longer words."""

    def __init__(self, terms: list[tuple[str, bool]]):
        self.root: dict = {}
        # an edit past the first two letters leaves these as they are; one before leaves the next three, moved by one at most
        self.heads = {t[:2] for t, _ in terms}
        self.thirds = {t[2:5] for t, _ in terms if len(t) >= SHORTEST_MISSPELLED}
        for i, (term, stem) in enumerate(terms):
            node = self.root
            for c in term:
                node = node.setdefault(c, {})
            node.setdefault("", []).append((i, stem, len(term) >= SHORTEST_MISSPELLED))

    def possible(self, words: set[str]) -> list[str]:
        """The words that can match at all; most cannot, and need no walk."""
        a, b = self.heads, self.thirds
        return [w for w in words if w[:2] in a or w[2:5] in b or w[1:4] in b or w[3:6] in b]

    def match(self, word: str) -> tuple[int, int] | None:
        """The best term for a word: (edits 0 or 1, term). The automaton's states are bits: places of the word reached
        without an edit, and with one."""
        masks: dict[str, int] = {}
        for i, c in enumerate(word):
            masks[c] = masks.get(c, 0) | 1 << i
        done, best = 1 << len(word), None
        stack = [(self.root, 1, 2)]
        while stack:
            node, d0, d1 = stack.pop()
            for c, child in node.items():
                if c == "":
                    for term, stem, fuzzy in child:
                        if d0 if stem else d0 & done:
                            found = (0, term)
                        elif fuzzy and (d1 if stem else d1 & done):
                            found = (1, term)
                        else:
                            continue
                        if best is None or found < best:
                            best = found
                    continue
                m = masks.get(c, 0)
                e0 = (d0 & m) << 1
                e1 = ((d1 & m) << 1 | d0 << 1 | d0 | e0 << 1) & (2 * done - 1)
                if e0 | e1:
                    stack.append((child, e0, e1))
        return best


@dataclass
class Lexicon:
    terms: list[tuple[str, bool]]
    weights: list[tuple[float, float]]
    slope: float = 1.0
    offset: float = -3.0
    constant: float | None = None
    _trie: Trie | None = field(default=None, repr=False)
    _seen: set = field(default_factory=set, repr=False)
    _hits: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {"terms": self.terms, "weights": self.weights, "slope": self.slope, "offset": self.offset, "constant": self.constant}

    def __setstate__(self, state):
        self.__init__(**state)

    def hits(self, words: set[str]) -> list[str]:
        """The words of a set that match a term; their terms are in ``_hits``."""
        if self._trie is None:
            self._trie = Trie(self.terms)
        new = words - self._seen
        if new:
            if len(self._seen) > 150_000:
                self._seen.clear()
                self._hits.clear()
                new = words
            for w in self._trie.possible(new):
                if w not in self._hits and len(w) > 2 and (m := self._trie.match(w)) is not None:
                    self._hits[w] = m
            self._seen |= new
        return [w for w in self._hits.keys() & words] if len(self._hits) < len(words) else [w for w in words if w in self._hits]

    def evidence(self, text: str | None) -> float:
        """Sum over terms of weight times the strongest context of a hit."""
        low = (text or "").lower()
        found = self.hits(set(WORDS.findall(low)))
        if not found:
            return 0.0
        by_term: dict[tuple[int, int], float] = {}
        at = [(m.start(), m[0]) for m in WORDS.finditer(low)]
        wanted = set(found)
        marks = [m.start() for m in _QUOTES.finditer(low)]
        for i, (start, w) in enumerate(at):
            if w in wanted:
                edits, term = self._hits[w]
                x = self.context(at, i, marks)
                key = (term, edits)
                by_term[key] = max(by_term.get(key, 0.0), x)
        return sum(self.weights[t][e] * x for (t, e), x in by_term.items())

    @staticmethod
    def context(at: list[tuple[int, str]], i: int, marks: list[int]) -> float:
        around = {w for _, w in at[max(0, i - 6) : i + 3]}
        if around & REPORTING:
            return QUOTED
        if marks:
            start = at[i][0]
            lo, hi = at[max(0, i - 12)][0], at[min(len(at) - 1, i + 12)][0] + 24
            j = int(np.searchsorted(marks, start))
            if j % 2 == 1 and marks[j - 1] >= lo and j < len(marks) and marks[j] <= hi:
                return QUOTED
        return PERSONAL if {w for _, w in at[max(0, i - 3) : i + 4]} & SECOND else 1.0

    def score(self, text: str | None) -> float:
        if self.constant is not None:
            return self.constant
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.evidence(text) + self.offset, -30, 30))))


def term_counts(rows: DataFrame) -> DataFrame:
    """term, stem, toxic, clean (documents that have it), company (bits of the words before it in toxic ones).

    Counted by partition first; a partition's table is handed on whenever it is large.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: dict[tuple[str, bool], list[int]] = {}

        def out() -> pa.RecordBatch:
            keys, vals = list(table), list(table.values())
            return pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys]), pa.array([k[1] for k in keys], pa.bool_()), pa.array([v[0] for v in vals], pa.int64()), pa.array([v[1] for v in vals], pa.int64()), pa.array([v[2] for v in vals], pa.int64())],
                names=["term", "stem", "toxic", "clean", "company"],
            )

        for b in batches:
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = WORDS.findall((text or "").lower())
                company = dict.fromkeys(words, 0)
                if y:
                    for before, w in zip(["", *words], words):
                        company[w] |= 1 << (zlib.crc32(before.encode()) % 62)
                own: dict[tuple[str, bool], int] = {}
                for w, bits in company.items():
                    n = len(w)
                    if 2 < n < 40:
                        own[w, False] = bits
                        for k in range(4, min(n, 8)):
                            own[w[:k], True] = own.get((w[:k], True), 0) | bits
                for k, bits in own.items():
                    v = table.get(k)
                    if v is None:
                        v = table[k] = [0, 0, 0]
                    v[0 if y else 1] += 1
                    v[2] |= bits
            if len(table) > 300_000:
                yield out()
                table = {}
        if table:
            yield out()

    got = rows.mapInArrow(count, "term string, stem boolean, toxic long, clean long, company long")
    return got.groupBy("term", "stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.bit_or("company").alias("company"))


def _odds(toxic: float, clean: float, n_toxic: float, n_clean: float) -> float:
    return float(np.log((toxic + 0.5) / (n_toxic + 1)) - np.log((clean + 0.5) / (n_clean + 1)))


def choose(rows: list, n_toxic: int, n_clean: int, max_terms: int) -> list[tuple[str, bool]]:
    """Terms of the lexicon from counts (term, stem, toxic, clean, company).

    A term that stands in chance places has about 62 (1 - exp(-toxic / 62)) bits of company; 0.6 of that is asked for.
    """
    good = {(r["term"], r["stem"]): r for r in rows if _odds(r["toxic"], r["clean"], n_toxic, n_clean) >= 2.5 and bin(r["company"]).count("1") >= max(3, 37 * (1 - np.exp(-r["toxic"] / 62)))}
    words_of: dict[str, float] = {}
    for (t, stem), r in good.items():
        if not stem:
            for k in range(4, min(len(t), 8)):
                words_of[t[:k]] = max(words_of.get(t[:k], 0), r["toxic"])
    stems = set()
    for (t, stem), r in sorted((x for x in good.items() if x[0][1]), key=lambda x: len(x[0][0])):
        # a stem says more than each of its words; of a chain of stems, the longest that keeps nearly all
        if r["toxic"] > 1.5 * words_of.get(t, 0) and r["toxic"] >= 4:
            longer = [u for u in good if u[1] and len(u[0]) == len(t) + 1 and u[0].startswith(t) and good[u]["toxic"] >= 0.9 * r["toxic"]]
            if not longer and not any(t.startswith(s) for s in stems):
                stems.add(t)
    out = [(t, True) for t in stems]
    out += [(t, False) for (t, stem) in good if not stem and not any(t.startswith(s) for s in stems)]
    return sorted(out, key=lambda k: (-good[k]["toxic"], k))[:max_terms]


def _logistic(s: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of y over s, with a weak prior, by Newton steps."""
    x = np.stack([s, np.ones_like(s)], 1)
    b = np.zeros(2)
    prior = np.array([0.02, 0.02])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        g = x.T @ (y - p) - prior * b
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(prior)
        step = np.linalg.solve(h, g)
        b += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return float(b[0]), float(b[1])


def train(docs: DataFrame, labels: DataFrame, *, modulus: int = 5, held_out: int = 0, max_rows: int = 12_000, max_terms: int = 1_000) -> Lexicon:
    """The lexicon and its curve, from at most about ``max_rows`` labelled rows."""
    known = teaching(labels, modulus, held_out).filter(F.col("toxic").isin(0, 1)).select(F.col("doc_id").alias("_doc"), F.col("toxic").cast("int").alias("y"))
    n = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    total = sum(n.values())
    if len(n) < 2:
        return Lexicon([], [], constant=float(next(iter(n), 0)))
    share = min(1.0, 0.97 * max_rows / total) * (1 << 30)
    sample = known.filter(F.pmod(F.xxhash64("_doc"), F.lit(1 << 30)) < int(np.ceil(share)))
    # bounded by max_rows, so it can go to every worker
    rows = written(docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("_doc")).select("text", "y"), "toxicity-sample")
    bounded_batches(docs.sparkSession)
    n = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    if len(n) < 2:
        return Lexicon([], [], constant=float(next(iter(n), 0)))
    n_toxic, n_clean = n[1], n[0]
    least = max(3, int(0.005 * n_toxic))
    ratio = 12 * (n_clean + 1) / (n_toxic + 1)  # only terms of enough log odds come back: the sample bounds their number
    counts = term_counts(rows).filter((F.col("toxic") >= least) & (F.col("toxic") + 0.5 >= (F.col("clean") + 0.5) / ratio * 144))
    terms = choose(counts.collect(), n_toxic, n_clean, max_terms)
    if not terms:
        return Lexicon([], [], constant=0.0)
    plain = Lexicon(terms, [(1.0, 1.0)] * len(terms))

    def by_term(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(terms), 2, 2))
        for b in batches:
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for e, t in {plain._hits[w] for w in plain.hits(set(WORDS.findall((text or "").lower())))}:
                    sums[t, e, y] += 1
        at = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int32()) for x in at] + [pa.array(sums[at])], names=["t", "e", "y", "v"])

    sums = np.zeros((len(terms), 2, 2))
    for r in rows.mapInArrow(by_term, "t int, e int, y int, v double").groupBy("t", "e", "y").agg(F.sum("v").alias("v")).collect():
        sums[r["t"], r["e"], r["y"]] = r["v"]
    weights = []
    for t in range(len(terms)):
        exact = float(np.clip(_odds(sums[t, 0, 1], sums[t, 0, 0], n_toxic, n_clean), 0, 6))
        near = sums[t, 1]
        if near[0] <= max(1.0, 0.0005 * n_clean):
            fuzzy = 0.7 * exact
        else:
            fuzzy = float(np.clip(_odds(near[1], near[0], n_toxic, n_clean), 0, 0.7 * exact))
        weights.append((exact, fuzzy))
    lexicon = Lexicon(terms, weights)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([round(min(12.0, lexicon.evidence(t)), 1) for t in b.column(0).to_pylist()]), b.column(1)], names=["s", "y"])

    table = rows.mapInArrow(weigh, "s double, y int").groupBy("s", "y").count().collect()  # 242 rows at most
    s, y, k = (np.array([float(r[c]) for r in table]) for c in ("s", "y", "count"))
    reps = np.maximum(1, np.round(k / max(1.0, k.sum() / 20_000))).astype(int)
    lexicon.slope, lexicon.offset = _logistic(np.repeat(s, reps), np.repeat(y, reps))
    return lexicon


def scored(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 512):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([lexicon.score(t) for t in b.column(1).to_pylist()], pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def toxicity_scores(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, score (0 to 1, higher: toxic) of every document."""
    return scored(docs, train(docs, labels, **options))


def keep_civil(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.5, **options) -> DataFrame:
    """The documents, all columns, that score below ``threshold``."""
    lexicon = train(docs, labels, **options)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([lexicon.score(t) for t in texts], dtype=float)

    bounded_batches(docs.sparkSession)
    return docs.filter(score(F.col("text")) < threshold)
