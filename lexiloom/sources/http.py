"""HTTP connectors: pages of a site, embedding and chat services. All network access goes through ``Transport``, which
tests replace. Jobs fetch inside partitions (``fetched``); a query never does."""

from __future__ import annotations

import base64
import json
import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.sources.clients import Breaker, loose_json, retrying

USER_AGENT = "LexiloomCrawler/1.0"
RETRIED = (500, 502, 503, 504)


class HttpError(RuntimeError):
    def __init__(self, status: int, body: str = "", retry_after: float | None = None):
        super().__init__(f"HTTP {status}")
        self.status, self.body, self.retry_after = status, body, retry_after


class Retried(HttpError):
    """An answer that may be better next time."""


def basic_token(user: str, password: str) -> str:
    """The value of an Authorization header's Basic scheme."""
    return base64.b64encode(f"{user}:{password}".encode()).decode()


def urllib_transport(url: str, data: bytes | None, headers: dict[str, str], timeout: float) -> tuple[int, bytes, dict[str, str]]:
    """Status, body and headers of a request; an error status is an answer too."""
    request = urllib.request.Request(url, data=data, headers=headers)
    try:
        with urllib.request.urlopen(request, timeout=timeout) as r:  # noqa: S310
            return r.status, r.read(), dict(r.headers)
    except urllib.error.HTTPError as e:
        return e.code, e.read(), dict(e.headers or {})


Transport = Callable[[str, bytes | None, dict[str, str], float], tuple[int, bytes, dict[str, str]]]


@dataclass
class Http:
    """Requests with retries: of a page for server errors and broken connections, of a service for 429 too."""

    transport: Transport = urllib_transport
    tries: int = 4
    delay: float = 1.0
    timeout: float = 30.0
    headers: dict[str, str] = field(default_factory=dict)
    sleep: Callable[[float], None] = time.sleep

    def _once(self, url: str, data: bytes | None, headers: dict[str, str], retried: tuple[int, ...]) -> tuple[int, str]:
        status, body, got = self.transport(url, data, {**self.headers, **headers}, self.timeout)
        text = body.decode("utf-8", "replace")
        if status in retried:
            after = next((v for k, v in got.items() if k.lower() == "retry-after"), "")
            raise Retried(status, text, float(after) if re.fullmatch(r"\d+", str(after).strip()) else None)
        if status >= 400:
            raise HttpError(status, text)
        return status, text

    def get(self, url: str) -> tuple[int, str]:
        """Status and text of a page."""
        run = retrying(self._once, self.tries, self.delay, 2.0, (Retried, OSError), self.sleep)
        return run(url, None, {"User-Agent": USER_AGENT}, RETRIED)

    def post(self, url: str, value: Any) -> Any:
        """The JSON answer to a JSON request. A whole-number Retry-After sets the wait."""
        run = retrying(self._once, self.tries, self.delay, 2.0, (Retried, OSError), self.sleep)
        _, text = run(url, json.dumps(value).encode(), {"Content-Type": "application/json"}, (429, *RETRIED))
        return json.loads(text)


@dataclass
class HttpEmbedder:
    """A service that takes ``{"texts": [...]}`` and gives ``{"embeddings": [...]}``."""

    endpoint: str
    http: Http = field(default_factory=Http)
    breaker: Breaker = field(default_factory=Breaker)

    def embed(self, texts: list[str]) -> list[list[float]]:
        got = self.breaker.call(self.http.post, self.endpoint, {"texts": texts})["embeddings"]
        if len(got) != len(texts):
            raise ValueError(f"{len(got)} embeddings for {len(texts)} texts")
        return got


@dataclass
class ListedEmbedder:
    """A service that takes ``{"model": ..., "input": [...]}`` and gives ``{"data": [{"index": i, "embedding": [...]}]}``."""

    endpoint: str
    model: str
    http: Http = field(default_factory=Http)
    breaker: Breaker = field(default_factory=Breaker)

    def embed(self, texts: list[str]) -> list[list[float]]:
        rows = self.breaker.call(self.http.post, self.endpoint, {"model": self.model, "input": texts})["data"]
        if len(rows) != len(texts):
            raise ValueError(f"{len(rows)} embeddings for {len(texts)} texts")
        return [r["embedding"] for r in sorted(rows, key=lambda r: r["index"])]


class _Json:
    def complete_json(self, prompt: str, system: str | None = None) -> Any:
        """The answer as JSON, fenced or bare; ValueError if there is none."""
        got = loose_json(self.complete(prompt, system))
        if got is None:
            raise ValueError("no JSON in the answer")
        return got


@dataclass
class HttpChat(_Json):
    """A service that takes ``{"prompt": ..., "system": ...}`` and gives ``{"response": ...}``."""

    endpoint: str
    http: Http = field(default_factory=Http)
    breaker: Breaker = field(default_factory=Breaker)

    def complete(self, prompt: str, system: str | None = None) -> str:
        asked = {"prompt": prompt} if system is None else {"prompt": prompt, "system": system}
        return self.breaker.call(self.http.post, self.endpoint, asked)["response"]


@dataclass
class MessagesChat(_Json):
    """A service that takes a list of messages and gives ``{"choices": [{"message": {"content": ...}}]}``."""

    endpoint: str
    model: str
    http: Http = field(default_factory=Http)
    breaker: Breaker = field(default_factory=Breaker)

    def complete(self, prompt: str, system: str | None = None) -> str:
        said = [{"role": "system", "content": system}] if system is not None else []
        asked = {"model": self.model, "messages": [*said, {"role": "user", "content": prompt}]}
        return self.breaker.call(self.http.post, self.endpoint, asked)["choices"][0]["message"]["content"]


def fetched(urls: DataFrame, http: Http | None = None, delay: float = 0.0) -> DataFrame:
    """url, html, status_code, outcome (success or failure), error of (url), fetched inside the partitions.

    Partition by host first, so that ``delay`` holds for each host: ``fetched(urls.repartition("host"))``.
    """
    http = http or Http()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, url in enumerate(b.column(0).to_pylist()):
                if i and delay:
                    time.sleep(delay)
                try:
                    status, html = http.get(url)
                    rows.append((url, html, status, "success", None))
                except (HttpError, OSError) as e:
                    rows.append((url, None, getattr(e, "status", None), "failure", str(e)))
            kinds = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.string())
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["url", "html", "status_code", "outcome", "error"])

    return urls.select(F.col("url").cast("string").alias("url")).mapInArrow(run, "url string, html string, status_code int, outcome string, error string")
