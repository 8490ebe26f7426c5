"""Token counts at every prefix of a text, for the word-level byte-pair vocabulary of a ``tokenizers`` file.

A text is normalised (NFC, lower case) and cut into words as the file's own pattern does; a word is encoded alone, so
a prefix of the text costs the words before it and the prefix of one word. Inside a word, dynamic programming over its
prefixes keeps for each the last token of its encoding: the token ``t`` that ends there and may follow the last token
of the prefix before ``t`` (two tokens may stand side by side if encoding their joint string gives just these two). An
automaton of the vocabulary names the tokens that end at a place. A word seen before costs one look-up. What is kept is
bounded by bytes. A word of any length takes memory in proportion to its length; parts of more than 64 characters
between blanks are not kept.

The table kept for a text has one signed byte for each of its code points: by how many tokens the count changes there.
Its running sum is the exact token count at every prefix; truncation and budget questions read it and nothing else.

Defined results: null and empty texts have no prefix and 0 tokens. In a text that is not in NFC or whose lower case
has another length, prefixes are counted at the ends of grapheme clusters (a position inside one has the count before
it), and inside the file's special strings, where they stand in a text, likewise. Repeated rows are counted each;
columns other than ``doc_id`` and ``text`` are dropped by ``prefix_table``, whatever their names; an empty table gives an
empty one.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterator
from itertools import accumulate, islice, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lexiloom.llm.common import bounded_batches, held, slices

_WS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def _other_numbers() -> str:
    """A character class of the numbers that are no decimal digits: ``\\w`` holds them, but they are no letters."""
    cps = [i for i in range(sys.maxunicode + 1) if unicodedata.category(chr(i)) in ("Nl", "No")]
    runs: list[list[int]] = []
    for i in cps:
        if runs and runs[-1][1] == i - 1:
            runs[-1][1] = i
        else:
            runs.append([i, i])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs)


def _byte_chars() -> list[str]:
    """The printable stand-ins of the 256 bytes that byte-level vocabularies use."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 256
    for b in range(256):
        if b in kept:
            out[b] = chr(b)
        else:
            out[b] = chr(extra)
            extra += 1
    return out


class Words:
    """How a tokenizer file cuts a text into words: its special strings, then its pattern."""

    def __init__(self, spec: dict):
        self.special = [t["content"] for t in spec["added_tokens"] if t["special"]]
        self.special_ids = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
        self.special_parts = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        num = _other_numbers()
        self.words = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[^\\W\\d_{num}]+|[\\d{num}]|(?:[^\\w{_WS}]++|_)++")

    def has_special(self, text: str) -> bool:
        return any(s in text for s in self.special)


class WordTokens(Words):
    """Words and the tokens at each of their prefixes, for one tokenizer file; lives in a worker process.

    Tokens are small integers here, 0 is none; a pair of tokens is one integer, the left one shifted by ``bits``.
    """

    #: Bytes of words' tables that are kept from text to text at most, about, and pairs of tokens. Tables stand in two
    #: generations of half the bytes: what is not met again while a generation fills goes after it.
    LIMIT, PAIRS = 192 << 20, 600_000

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        super().__init__(spec)
        end, vocab = spec["model"]["end_of_word_suffix"], spec["model"]["vocab"]
        merges = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        token = {t: i for i, t in enumerate(vocab, 1)}
        self.bits = len(token).bit_length()
        # a token's age is the merge that makes it, a single symbol's is below all merges; parts: what it was made of
        self.age = [0, *range(-len(token), 0)]
        self.parts: list[tuple[int, int] | None] = [None] * (len(token) + 1)
        for i, (x, y) in enumerate(merges):
            if self.parts[t := token[x + y]] is None:
                self.age[t] = i
                self.parts[t] = (token[x], token[y])
        self.made = {token[x] << self.bits | token[y]: self.age[token[x + y]] for x, y in merges}
        # by string: its length and the token that it is inside a word, and its length and the token that it is at a word's end
        self.inside: dict[str, tuple[int, int]] = {}
        self.ending: dict[str, tuple[int, int]] = {}
        for t, i in token.items():
            if t.endswith(end):
                t = t[: -len(end)]
                self.ending[t] = (len(t), i)
            else:
                self.inside[t] = (len(t), i)
        self.begins = {t[:k] for t in (*self.inside, *self.ending) for k in range(len(t) + 1)}
        # an automaton, made as far as texts ask for it: a node stands for the longest end of what was read that begins a
        # token; it has the nodes after it by symbol, the tokens that end there inside a word and at a word's end, the
        # longest first, and its string
        self.nodes: dict[str, tuple] = {}
        self.root = ({}, (), (), "")
        self.chars = _byte_chars()
        self.pairs: dict[int, bool] = {}
        # tables of words and of other parts between blanks
        self.deltas: dict[str, bytes] = {}
        self.older_deltas: dict[str, bytes] = {}
        self.held_bytes = 0

    def trim(self) -> None:
        """A full generation becomes the older one; no reader leans on what is kept."""
        if self.held_bytes > self.LIMIT // 2:
            self.older_deltas, self.deltas = self.deltas, {}
            self.held_bytes = 0

    def fits(self, pair: int) -> bool:
        """Whether the right token may follow the left one: no merge across their border comes before those that made them.

        Walks back the youngest merge of the two along the border; if the tokens at the border have a merge that is
        older than what was undone so far, encoding would have made it.
        """
        if (known := self.pairs.get(pair)) is not None:
            return known
        if len(self.pairs) > self.PAIRS:  # no reader leans on a pair that is kept
            self.pairs.clear()
        age, parts, made, bits, limit = self.age, self.parts, self.made, self.bits, 1 << 60
        left, right = pair >> bits, pair & ((1 << bits) - 1)
        while True:
            if made.get(left << bits | right, limit) < limit:
                known = False
                break
            a, b = age[left], age[right]
            if a > b and parts[left]:
                limit, left = a, parts[left][1]
            elif parts[right]:
                limit, right = b + 1, parts[right][0]
            elif parts[left]:
                limit, left = a, parts[left][1]
            else:
                known = True
                break
        self.pairs[pair] = known
        return known

    # -- dynamic programming over the prefixes of a word

    def symbols(self, word: str) -> str:
        """A word as the stand-ins of its bytes."""
        if word.isascii() and word.isprintable():
            return word
        return "".join(map(self.chars.__getitem__, word.encode()))

    def step(self, node: tuple, symbol: str) -> tuple:
        """The node after ``node``, kept there."""
        string = node[3] + symbol
        while string not in self.begins:
            string = string[1:]
        if string not in self.nodes:
            ends = [string[i:] for i in range(len(string))]
            self.nodes[string] = ({}, *(tuple(d[e] for e in ends if e in d) for d in (self.inside, self.ending)), string)
        node[0][symbol] = self.nodes[string]
        return self.nodes[string]

    def word_deltas(self, word: str) -> bytes:
        """For each code point of a word, the change of the token count of the prefix that ends there.

        Of the tokens that end at a place one follows; the shortest, a symbol, does so if no other does.
        """
        s = self.symbols(word)
        pairs, fits, bits, step, node = self.pairs.get, self.fits, self.bits, self.step, self.root
        # by place the last token, shifted, the count of tokens, and the count where the word ends there
        lasts, inners, finals = ([0], [0], [0]) if len(s) <= 64 else (array("q", [0]), array("q", [0]), array("q", [0]))
        for k, c in enumerate(s, 1):
            node = node[0].get(c) or step(node, c)
            for size, t in node[2]:
                if not (left := lasts[k - size]) or (fit := pairs(left | t)) or fit is None and fits(left | t):
                    break
            finals.append(inners[k - size] + 1)
            for size, t in node[1]:
                if not (left := lasts[k - size]) or (fit := pairs(left | t)) or fit is None and fits(left | t):
                    break
            inners.append(inners[k - size] + 1)
            lasts.append(t << bits)
        if len(s) > len(word):
            finals = [0, *map(finals.__getitem__, accumulate(1 + (c > "\x7f") + (c > "\u07ff") + (c > "\uffff") for c in word))]
        return bytes([b - a & 255 for a, b in pairwise(finals)])

    def chunk_deltas(self, chunk: str) -> bytes:
        """Of a part of a normalised text between two blanks; other white space may stand in it."""
        if (d := self.older_deltas.get(chunk)) is None:
            if chunk.isalpha():
                d = self.word_deltas(chunk)
            else:
                out, at, known, older = [], 0, self.deltas.get, self.older_deltas.get
                for m in self.words.finditer(chunk):
                    w = m[0]
                    out += [bytes(m.start() - at), known(w) or older(w) or self.split_deltas(w)]
                    at = m.end()
                d = b"".join(out) + bytes(len(chunk) - at)
        if len(chunk) <= 64:
            self.held_bytes += 200 + 2 * len(chunk)
            self.deltas[chunk] = d
        return d

    def split_deltas(self, word: str) -> bytes:
        """As a prefix of the text, an unfinished contraction is a quote and a letter: two words."""
        if word in ("'re", "'ve", "'ll"):
            part = 1 + self.total_word(word[1]) - 1
            return bytes([1, part & 255, (self.total_word(word) - 1 - part) & 255])
        return self.word_deltas(word)

    def total_word(self, word: str) -> int:
        return int(np.frombuffer(self.word_deltas(word), np.int8).sum())

    def text_deltas(self, text: str) -> bytes:
        """The table of a text: a signed byte for each code point."""
        self.trim()
        if self.has_special(text):
            out = []
            for part in self.special_parts.split(text):
                out.append(bytes(len(part) - 1) + b"\x01" if part in self.special_ids else self.plain_deltas(part))
            return b"".join(out)
        return self.plain_deltas(text)

    def plain_deltas(self, text: str) -> bytes:
        if unicodedata.is_normalized("NFC", text):
            low = text.replace("Σ", "σ").lower() if "Σ" in text else text.lower()
            if len(low) == len(text):
                return self.normal_deltas(low)
        import regex

        parts, sizes = [], []
        for cluster in regex.findall(r"\X", text):
            low = "".join(c.lower() for c in unicodedata.normalize("NFC", cluster))
            parts.append(low)
            sizes.append((len(cluster), len(low)))
        inner = np.cumsum(np.frombuffer(self.normal_deltas("".join(parts)), np.int8).astype(np.int64))
        out, at, before = bytearray(), 0, 0
        for a, b in sizes:
            at += b
            now = int(inner[at - 1]) if at else 0
            out += bytes(a - 1) + bytes([(now - before) & 255])
            before = now
        return bytes(out)

    def normal_deltas(self, low: str) -> bytes:
        known, make = self.deltas.get, self.chunk_deltas
        chunks = low.replace("\n", " ").split(" ")
        out = list(map(known, chunks))
        if None in out:
            for i, d in enumerate(out):
                if d is None:
                    out[i] = known(chunks[i]) or make(chunks[i])
        return b"\0".join(out)


class IdTokens(Words):
    """Whole encodings, for packing: the library's ids, and those of words seen before from a table."""

    #: Bytes of the table at most, about; words beyond it are encoded each time.
    LIMIT = 64 << 20

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        super().__init__(spec)
        end, vocab = spec["model"]["end_of_word_suffix"], spec["model"]["vocab"]
        self.library = Tokenizer.from_file(path)
        self.library.normalizer = None  # it gets words of normalised texts
        self.ends = np.zeros(max([*vocab.values(), *self.special_ids.values()]) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith(end)]] = True
        self.ids: dict[str, bytes] = {"": b""}
        self.held_bytes = 0

    def make_ids(self, chunks: list[str]) -> list[bytes]:
        """Ids of parts of a text between blanks, from those of their words; the library gets each word that is not known once."""
        known, find = self.ids, self.words.findall
        parts = {c: [c] if c.isalpha() else find(c) for c in chunks}
        own = dict.fromkeys([w for words in parts.values() for w in words if w not in known])
        if own:  # one call (without offsets), cut after the tokens that end a word
            ids = np.array(self.library.encode_batch_fast([" ".join(own)], add_special_tokens=False)[0].ids, "<u4")
            ends = [0, *(np.flatnonzero(self.ends[ids]) * 4 + 4).tolist()]
            raw = ids.tobytes()
            own = {w: raw[i:j] for w, i, j in zip(own, ends, ends[1:])}
        n_words = len(own)
        for c, words in parts.items():
            if c not in own:
                own[c] = b"".join([known.get(w) or own[w] for w in words])
        if self.held_bytes < self.LIMIT:
            # parts of several words have one half of the table at most
            for c in own if self.held_bytes < self.LIMIT // 2 else islice(own, n_words):
                if len(c) <= 64:
                    known[c] = own[c]
                    self.held_bytes += 200 + len(c) + len(own[c])
        return [own[c] for c in chunks]

    def text_ids(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        if self.has_special(text):
            return b"".join(self.special_ids[x].to_bytes(4, "little") if x in self.special_ids else self.text_ids(x) for x in self.special_parts.split(text))
        text = unicodedata.normalize("NFC", text)
        low = "".join(c.lower() for c in text) if "Σ" in text else text.lower()
        chunks = low.replace("\n", " ").split(" ")
        out = list(map(self.ids.get, chunks))
        if None in out:
            at = [i for i, d in enumerate(out) if d is None]
            for i, d in zip(at, self.make_ids([chunks[i] for i in at])):
                out[i] = d
        return b"".join(out)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


PREFIX_SCHEMA = "doc_id long, n_bytes long, n_tokens long, prefix_deltas binary"


def prefix_table(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens (of the whole text), prefix_deltas (see above), by document."""
    path = tokenizer_path or default_path()
    bounded_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = held(f"word tokens {path}", lambda: WordTokens(path))
        for b in slices(batches, 512):
            texts = [x or "" for x in b.column(1).to_pylist()]
            tables = [t.text_deltas(x) for x in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([len(x.encode()) for x in texts], pa.int64()),
                    pa.array([int(np.frombuffer(d, np.int8).sum()) for d in tables], pa.int64()),
                    pa.array(tables, pa.binary()),
                ],
                names=["doc_id", "n_bytes", "n_tokens", "prefix_deltas"],
            )

    return docs.select("doc_id", "text").mapInArrow(count, PREFIX_SCHEMA)


def tokens_at(deltas: bytes, prefix: int) -> int:
    """Tokens of the first ``prefix`` code points."""
    return int(np.frombuffer(deltas[:prefix], np.int8).sum())


def longest_prefix(deltas: bytes, budget: int) -> int:
    """Code points of the longest prefix of at most ``budget`` tokens."""
    within = np.flatnonzero(np.cumsum(np.frombuffer(deltas, np.int8).astype(np.int64)) <= budget)
    return int(within[-1]) + 1 if len(within) else 0


def fitting_prefix(table: DataFrame, budget: int) -> DataFrame:
    """Adds fit_chars: code points of each document's longest prefix within ``budget`` tokens, read from its table."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fit = [longest_prefix(d, budget) for d in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(fit, pa.int64())], names=["doc_id", "n_bytes", "n_tokens", "fit_chars"])

    return table.mapInArrow(look, "doc_id long, n_bytes long, n_tokens long, fit_chars long")
