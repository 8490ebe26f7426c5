"""What is injected from outside: embedders and chat models, with retry and a circuit breaker around them."""

from __future__ import annotations

import hashlib
import json
import re
import time
from collections.abc import Callable
from typing import Any, Protocol

import numpy as np


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Chat(Protocol):
    def complete(self, prompt: str, system: str | None = None) -> str: ...


class HashEmbedder:
    """Deterministic embeddings without a model: signed hash buckets of words, of length one. For tests and offline use."""

    def __init__(self, dimension: int = 64):
        self.dimension = dimension

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            x = np.zeros(self.dimension)
            for w in (t or "").lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                x[h % self.dimension] += 1 if h >> 63 else -1
            n = np.sqrt((x * x).sum())
            out.append((x / n if n else x).tolist())
        return out


class ScriptedChat:
    """Answers by a function of the prompt."""

    def __init__(self, answer: Callable[[str], str]):
        self.answer = answer

    def complete(self, prompt: str, system: str | None = None) -> str:
        return self.answer(prompt)


class CircuitOpen(RuntimeError):
    pass


class Breaker:
    """Refuses calls for ``rest`` seconds after ``most`` failures in a row; then lets one try."""

    def __init__(self, most: int = 5, rest: float = 60.0, clock: Callable[[], float] = time.monotonic):
        self.most, self.rest, self.clock = most, rest, clock
        self.failures, self.opened = 0, None

    @property
    def state(self) -> str:
        if self.opened is None:
            return "closed"
        return "half-open" if self.clock() - self.opened >= self.rest else "open"

    def call(self, f: Callable, *args: Any, **kw: Any) -> Any:
        if self.state == "open":
            raise CircuitOpen("too many failures")
        try:
            out = f(*args, **kw)
        except Exception:
            self.failures += 1
            if self.failures >= self.most:
                self.opened = self.clock()
            raise
        self.failures, self.opened = 0, None
        return out


def retrying(f: Callable, tries: int = 3, delay: float = 1.0, backoff: float = 2.0, on: tuple = (Exception,), sleep=time.sleep) -> Callable:
    """``f`` tried ``tries`` times; waits grow by ``backoff``; an error with ``retry_after`` seconds sets its own wait."""

    def run(*args: Any, **kw: Any) -> Any:
        for i in range(tries):
            try:
                return f(*args, **kw)
            except on as e:
                if i + 1 == tries:
                    raise
                after = getattr(e, "retry_after", None)
                sleep(after if isinstance(after, (int, float)) else delay * backoff**i)

    return run


def loose_json(text: str | None, default: Any = None) -> Any:
    """JSON of a model's answer: the whole text, or a fenced block in it, or the first object or array."""
    tries = [text or ""]
    tries += re.findall(r"```(?:json)?\s*(.*?)```", text or "", re.S)
    for t in tries:
        try:
            return json.loads(t)
        except ValueError:
            pass
    decoder = json.JSONDecoder()
    for m in re.finditer(r"[{\[]", text or ""):
        try:
            return decoder.raw_decode(text, m.start())[0]
        except ValueError:
            pass
    return default
