"""Chunkers: characters, estimated tokens, Markdown sections and the two-level chunks that are indexed.

The loops carry their position along, so they run in Python workers, an array of structs per document; everything around
them (explode, ids, parents) is plain DataFrame work. An overlap that would stop the loop from moving on is cut short,
so every chunker ends on every input.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from lexiloom.functions.text import ESTIMATE_PUNCTUATION

# Fixed values.
SMALL, LARGE, OVERLAP = 500, 2000, 100
SENTENCE_ENDS = (". ", "! ", "? ", ".\n", "!\n", "?\n")
_HEADING = re.compile(r"^(#{1,6})\s+(.+?)(?:\s*#*)?$", re.M)


def word_cost(word: str) -> int:
    """Estimated tokens of a word; see ``functions.text.estimate_tokens``."""
    core = word.strip(ESTIMATE_PUNCTUATION)
    return 1 + len(word) - len(core) + max(0, len(core) - 10) // 5 if core else 1


def by_characters(text: str, size: int = SMALL, overlap: int = OVERLAP) -> list[str]:
    """Windows of ``size`` characters that end after a sentence, or else a word, in their second half."""
    if len(text) <= size:
        return [text] if text else []
    out, start, half = [], 0, size // 2
    while start < len(text):
        end = start + size
        if end < len(text):
            stop = max(text.rfind(m, start, end) for m in SENTENCE_ENDS) - start
            blank = text.rfind(" ", start, end) - start
            end = start + (stop + 1 if stop > half else blank if blank > half else size)
        out.append(text[start:end].strip())
        if end >= len(text):
            break
        start = max(start + 1, end - overlap)
    return [x for x in out if x]


def by_tokens(text: str, most: int = 128, overlap: int = 25) -> list[str]:
    """Runs of words of at most ``most`` estimated tokens; the next run begins with the last words worth ``overlap``."""
    words = text.split()
    costs = [word_cost(w) for w in words]
    if sum(costs) <= most:
        return [text] if text else []
    out, first, used = [], 0, 0
    for i, cost in enumerate(costs):
        if used + cost > most and i > first:
            out.append(" ".join(words[first:i]))
            keep, kept = i, 0
            while keep > first and kept + costs[keep - 1] <= overlap:
                keep -= 1
                kept += costs[keep]
            first, used = keep, kept
        used += cost
    out.append(" ".join(words[first:]))
    return out


def heading_path(headings: list[tuple[int, str]], deepest: int = 6) -> str:
    """The chain of open headings, ``A > B``; a heading closes those of its level and below."""
    chain: list[tuple[int, str]] = []
    for level, text in headings:
        chain = [h for h in chain if h[0] < level] + [(level, text)]
    return " > ".join(t for level, t in chain if level <= deepest)


def markdown_headings(md: str) -> list[tuple[int, str, int]]:
    return [(len(m[1]), m[2].strip(), m.start()) for m in _HEADING.finditer(md)]


def markdown_sections(md: str) -> list[dict]:
    """A section for each heading; text before the first is dropped; one nameless section where there is none."""
    heads = markdown_headings(md)
    if not heads:
        return [{"content": md, "heading": "", "level": 0, "heading_path": ""}]
    ends = [h[2] for h in heads[1:]] + [len(md)]
    out, chain = [], []
    for (level, text, start), end in zip(heads, ends):
        chain = [h for h in chain if h[0] < level] + [(level, text)]
        out.append({"content": md[start:end].strip(), "heading": text, "level": level, "heading_path": " > ".join(t for _, t in chain)})
    return out


def text_sections(text: str, headings: list[tuple[int, str]]) -> list[dict]:
    """Sections of plain text that begin where each heading's words first stand."""
    at = sorted(((text.find(t), i, level, t) for i, (level, t) in enumerate(headings) if t in text), key=lambda x: x[:2])
    if not at:
        return [{"content": text, "heading_path": "", "level": 0}]
    ends = [x[0] for x in at[1:]] + [len(text)]
    return [
        {"content": text[start:end].strip(), "heading_path": heading_path([(lv, t) for _, _, lv, t in at[: k + 1]], level), "level": level}
        for k, ((start, _, level, _), end) in enumerate(zip(at, ends))
    ]


def two_level(sections: list[dict], small: int = SMALL, large: int = LARGE, overlap: int = OVERLAP) -> list[dict]:
    """Large chunks of the sections, then small chunks of each large one with half the overlap."""
    big = [(c, s["heading_path"]) for s in sections if s["content"].strip() for c in by_characters(s["content"], large, overlap) if c.strip()]
    out = [{"type": "large", "index": i, "content": c, "heading_path": p, "parent_index": None} for i, (c, p) in enumerate(big)]
    little = [(c, p, i) for i, (b, p) in enumerate(big) for c in by_characters(b, small, overlap // 2) if c.strip()]
    return out + [{"type": "small", "index": k, "content": c, "heading_path": p, "parent_index": i} for k, (c, p, i) in enumerate(little)]


TEXT, NUMBER = StringType(), IntegerType()
CHUNK = StructType().add("type", TEXT).add("index", NUMBER).add("content", TEXT).add("heading_path", TEXT).add("parent_index", NUMBER)
SECTION = StructType().add("content", TEXT).add("heading", TEXT).add("level", NUMBER).add("heading_path", TEXT)


def chunk_chars(size: int = SMALL, overlap: int = OVERLAP):
    @F.pandas_udf(ArrayType(TEXT))
    def run(text: pd.Series) -> pd.Series:
        return text.map(lambda t: by_characters(t or "", size, overlap))

    return run


def chunk_tokens(most: int = 128, overlap: int = 25):
    @F.pandas_udf(ArrayType(TEXT))
    def run(text: pd.Series) -> pd.Series:
        return text.map(lambda t: by_tokens(t or "", most, overlap))

    return run


@F.pandas_udf(ArrayType(SECTION))
def split_markdown(md: pd.Series) -> pd.Series:
    return md.map(lambda t: markdown_sections(t or ""))


def chunk_markdown(small: int = SMALL, large: int = LARGE, overlap: int = OVERLAP):
    @F.pandas_udf(ArrayType(CHUNK))
    def run(md: pd.Series) -> pd.Series:
        return md.map(lambda t: two_level(markdown_sections(t), small, large, overlap) if t else [])

    return run


def chunk_document(small: int = SMALL, large: int = LARGE, overlap: int = OVERLAP):
    """Plain text with the headings of its HTML: array<struct<level,text>>."""

    @F.pandas_udf(ArrayType(CHUNK))
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for text, heads in batches:
            yield pd.Series([two_level(text_sections(t, [(h["level"], h["text"]) for h in hs]), small, large, overlap) if t else [] for t, hs in zip(text, heads)], dtype=object)

    return run


def chunk_rows(pages: DataFrame, chunks: str = "chunks", page: str = "page_id") -> DataFrame:
    """A row per chunk of an array column: page, chunk_key ('type:index', unique in its page), parent_key and the fields."""
    rows = pages.select(page, F.explode(chunks).alias("_c"))
    key = lambda kind, i: F.concat(kind, F.lit(":"), i.cast("string"))
    return rows.select(
        page, key(F.col("_c.type"), F.col("_c.index")).alias("chunk_key"), key(F.lit("large"), F.col("_c.parent_index")).alias("parent_key"),
        F.col("_c.type").alias("chunk_type"), F.col("_c.index").alias("chunk_index"), F.col("_c.content").alias("content"), F.col("_c.heading_path").alias("heading_path"),
    )
