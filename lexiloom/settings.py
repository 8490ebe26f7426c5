"""Tunables: their defaults, the environment variables that set them, and the rules they must keep.

Variables are named ``LEXILOOM_`` and the field in capitals. An ``.env`` file may set what the environment does not.
"""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields

PREFIX = "LEXILOOM_"


@dataclass(frozen=True)
class Settings:
    small_chunk_size: int = 500
    large_chunk_size: int = 2000
    chunk_overlap: int = 100
    small_chunk_tokens: int = 128
    large_chunk_tokens: int = 512
    chunk_overlap_tokens: int = 25
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    vector_weight: float = 0.7
    bm25_weight: float = 0.3
    top_k_retrieval: int = 20
    top_k_final: int = 5
    max_chunks_per_page: int = 2
    confidence_threshold: float = 0.5
    embedding_batch_size: int = 100
    embedding_batch_delay: float = 0.1
    embedding_max_retries: int = 3
    embedding_retry_delay: float = 1.0
    crawl_delay_seconds: float = 1.0
    max_pages: int = 1000
    crawler_max_retries: int = 3
    crawler_retry_delay: float = 1.0
    excluded_paths: tuple[str, ...] = ("/api/", "/static/")
    max_query_length: int = 10_000
    query_cache_enabled: bool = True
    query_cache_size: int = 100
    query_cache_ttl: int = 3600
    ai_enabled: bool = False
    vector_api_endpoint: str = ""
    vector_api_key: str = ""
    chat_api_endpoint: str = ""
    chat_api_key: str = ""
    basic_auth_enabled: bool = False
    basic_auth_username: str = ""
    basic_auth_password: str = ""
    basic_auth_token: str = ""
    log_level: str = "INFO"
    log_format: str = "text"

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None) -> Settings:
        """Defaults, overlaid with what ``env`` sets; a value that does not parse raises ValueError with its name."""
        env = os.environ if env is None else env
        given = {}
        for f in fields(cls):
            raw = env.get(PREFIX + f.name.upper())
            if raw is not None:
                try:
                    given[f.name] = _parse(raw, type(f.default))
                except ValueError as e:
                    raise ValueError(f"{PREFIX}{f.name.upper()}: {e}") from None
        return cls(**given)


def _parse(raw: str, kind: type):
    if kind is bool:
        return raw.strip().lower() in ("1", "true", "yes", "on")
    if kind is tuple:
        return tuple(x.strip() for x in raw.split(",") if x.strip())
    return kind(raw)


def load_env(path: str, env: dict[str, str] | None = None) -> dict[str, str]:
    """NAME=value lines of a file, set where ``env`` has no such name; what was set. A missing file sets nothing.

    Blank lines and lines that begin with # are skipped; quotes around a whole value go.
    """
    env = os.environ if env is None else env
    made: dict[str, str] = {}
    if not os.path.exists(path):
        return made
    with open(path, encoding="utf-8") as f:
        for line in f:
            name, sign, value = line.strip().partition("=")
            name, value = name.strip(), value.strip()
            if not sign or not name or name.startswith("#"):
                continue
            if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'":
                value = value[1:-1]
            if name not in env:
                env[name] = made[name] = value
    return made


POSITIVE = ("max_pages", "small_chunk_size", "large_chunk_size", "small_chunk_tokens", "large_chunk_tokens", "top_k_retrieval", "top_k_final", "max_chunks_per_page", "embedding_batch_size", "query_cache_size", "max_query_length")
NOT_NEGATIVE = ("crawl_delay_seconds", "chunk_overlap", "chunk_overlap_tokens", "bm25_k1", "embedding_batch_delay", "embedding_max_retries", "embedding_retry_delay", "crawler_max_retries", "crawler_retry_delay", "query_cache_ttl")
SHARES = ("bm25_b", "vector_weight", "bm25_weight", "confidence_threshold")


def problems(s: Settings, require_apis: bool = False) -> list[str]:
    """What breaks a rule, a sentence each; empty if all is well."""
    out = [f"{n} must be positive, got {getattr(s, n)}" for n in POSITIVE if getattr(s, n) <= 0]
    out += [f"{n} must not be negative, got {getattr(s, n)}" for n in NOT_NEGATIVE if getattr(s, n) < 0]
    out += [f"{n} must lie between 0 and 1, got {getattr(s, n)}" for n in SHARES if not 0 <= getattr(s, n) <= 1]
    if s.small_chunk_size > s.large_chunk_size:
        out.append(f"small_chunk_size ({s.small_chunk_size}) must not exceed large_chunk_size ({s.large_chunk_size})")
    if s.chunk_overlap >= s.small_chunk_size > 0:
        out.append(f"chunk_overlap ({s.chunk_overlap}) must be less than small_chunk_size ({s.small_chunk_size})")
    if abs(s.vector_weight + s.bm25_weight - 1) > 0.01:
        out.append(f"vector_weight and bm25_weight must add up to 1, got {s.vector_weight + s.bm25_weight}")
    if require_apis:
        out += [f"{n} is not set" for n in ("vector_api_endpoint", "vector_api_key", "chat_api_endpoint", "chat_api_key") if not getattr(s, n)]
    if s.basic_auth_enabled and not s.basic_auth_token and not (s.basic_auth_username and s.basic_auth_password):
        out.append("basic authentication needs a token, or a user name and a password")
    return out
