"""Table functions for SQL: ``SELECT * FROM split_markdown(...)``, also with LATERAL over a column. The DataFrame forms are in
``functions.chunks``."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from lexiloom.functions import chunks


@udtf(returnType="position int, level int, heading string, heading_path string, content string")
class SplitMarkdown:
    """A row per section of a Markdown text."""

    def eval(self, md: str) -> Iterator[tuple]:
        for i, s in enumerate(chunks.markdown_sections(md or "")):
            yield i, s["level"], s["heading"], s["heading_path"], s["content"]


@udtf(returnType="position int, content string")
class ChunkText:
    """A row per chunk of at most ``size`` characters."""

    def eval(self, text: str, size: int, overlap: int) -> Iterator[tuple]:
        yield from enumerate(chunks.by_characters(text or "", size, overlap))


@udtf(returnType="position int, content string")
class ChunkTokens:
    """A row per chunk of at most ``most`` estimated tokens."""

    def eval(self, text: str, most: int, overlap: int) -> Iterator[tuple]:
        yield from enumerate(chunks.by_tokens(text or "", most, overlap))


@udtf(returnType="position int, chunk_type string, parent_index int, heading_path string, content string")
class ChunkMarkdown:
    """A row per large and small chunk of a Markdown text."""

    def eval(self, md: str) -> Iterator[tuple]:
        for i, c in enumerate(chunks.two_level(chunks.markdown_sections(md or ""))):
            yield i, c["type"], c["parent_index"], c["heading_path"], c["content"]


def register(spark: SparkSession) -> None:
    for name, f in (("split_markdown", SplitMarkdown), ("chunk_text", ChunkText), ("chunk_tokens", ChunkTokens), ("chunk_markdown", ChunkMarkdown)):
        spark.udtf.register(name, f)
