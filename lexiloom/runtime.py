"""What runs on the driver beside the data: a cache of answers, metrics and timers, logging, health, orderly shutdown."""

from __future__ import annotations

import json
import logging
import signal
import sys
import threading
import time
from collections import OrderedDict, defaultdict
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from typing import Any


class AnswerCache:
    """The most recently used values, each for ``ttl`` seconds (0 or less: for ever)."""

    def __init__(self, size: int = 100, ttl: float = 3600, clock: Callable[[], float] = time.monotonic):
        if size < 1:
            raise ValueError("a cache holds one value at least")
        self.size, self.ttl, self.clock = size, ttl, clock
        self._rows: OrderedDict[Any, tuple[float, Any]] = OrderedDict()
        self._lock = threading.RLock()
        self.hits = self.misses = self.evictions = self.expirations = 0

    def _old(self, at: float) -> bool:
        return self.ttl > 0 and self.clock() - at >= self.ttl

    def get(self, key: Any) -> Any | None:
        with self._lock:
            row = self._rows.get(key)
            if row is not None and self._old(row[0]):
                del self._rows[key]
                self.expirations += 1
                row = None
            if row is None:
                self.misses += 1
                return None
            self._rows.move_to_end(key)
            self.hits += 1
            return row[1]

    def put(self, key: Any, value: Any) -> None:
        with self._lock:
            self._rows.pop(key, None)
            while len(self._rows) >= self.size:
                self._rows.popitem(last=False)
                self.evictions += 1
            self._rows[key] = (self.clock(), value)

    def delete(self, key: Any) -> bool:
        with self._lock:
            return self._rows.pop(key, None) is not None

    def clear(self) -> None:
        """Forgets the values; the counts stay."""
        with self._lock:
            self._rows.clear()

    def cleanup(self) -> int:
        """Drops what is too old; how many."""
        with self._lock:
            old = [k for k, (at, _) in self._rows.items() if self._old(at)]
            for k in old:
                del self._rows[k]
            self.expirations += len(old)
            return len(old)

    def __len__(self) -> int:
        return len(self._rows)

    def stats(self) -> dict[str, Any]:
        asked = self.hits + self.misses
        return {
            "size": len(self._rows), "max_size": self.size, "hits": self.hits, "misses": self.misses, "evictions": self.evictions,
            "expirations": self.expirations, "hit_rate": round(self.hits / asked, 4) if asked else 0.0, "ttl_seconds": self.ttl,
        }


class Metrics:
    """Named values, and a row of values for each query."""

    def __init__(self, keep: int = 10_000):
        self.keep = keep
        self._values: dict[str, list[float]] = defaultdict(list)
        self.queries: list[dict[str, Any]] = []
        self._lock = threading.Lock()

    def record(self, name: str, value: float) -> None:
        with self._lock:
            own = self._values[name]
            own.append(float(value))
            del own[: max(0, len(own) - self.keep)]

    def record_query(self, **values: Any) -> None:
        with self._lock:
            self.queries.append(values)
            del self.queries[: max(0, len(self.queries) - self.keep)]

    def aggregates(self) -> dict[str, dict[str, float]]:
        with self._lock:
            return {k: {"count": len(v), "min": min(v), "max": max(v), "avg": sum(v) / len(v), "total": sum(v)} for k, v in self._values.items() if v}

    def reset(self) -> None:
        with self._lock:
            self._values.clear()
            self.queries.clear()


METRICS = Metrics()


class Timer:
    """``with Timer() as t: ...``; then ``t.seconds`` and ``t.ms``."""

    seconds = 0.0

    def __enter__(self) -> Timer:
        self._from = time.perf_counter()
        return self

    def __exit__(self, *_: Any) -> None:
        self.seconds = time.perf_counter() - self._from

    @property
    def ms(self) -> float:
        return self.seconds * 1000


@contextmanager
def timed(name: str, metrics: Metrics = METRICS) -> Iterator[Timer]:
    """Records how many milliseconds the block took, also if it fails."""
    t = Timer()
    try:
        with t:
            yield t
    finally:
        metrics.record(name, t.ms)


class JsonFormatter(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        row = {"timestamp": self.formatTime(record), "level": record.levelname, "logger": record.name, "message": record.getMessage(), **getattr(record, "context", {})}
        if record.exc_info:
            row["exception"] = self.formatException(record.exc_info)
        return json.dumps(row, ensure_ascii=False, default=str)


class PairsFormatter(logging.Formatter):
    """Text, with the context as name=value pairs."""

    def format(self, record: logging.LogRecord) -> str:
        context = getattr(record, "context", {})
        return super().format(record) + "".join(f" {k}={v}" for k, v in context.items())


def logger(name: str, level: str = "INFO", style: str = "text", stream: Any = None) -> logging.Logger:
    log = logging.getLogger(name)
    if not log.handlers:
        handler = logging.StreamHandler(stream or sys.stderr)
        handler.setFormatter(JsonFormatter() if style == "json" else PairsFormatter("%(asctime)s %(levelname)s %(name)s %(message)s"))
        log.addHandler(handler)
        log.propagate = False
    log.setLevel(level.upper())
    return log


def log_with(log: logging.Logger, level: int, message: str, **context: Any) -> None:
    log.log(level, message, extra={"context": context})


@dataclass
class Health:
    """Named checks; each returns a sentence, or raises what is wrong. A check that returns None was not configured."""

    checks: dict[str, Callable[[], str | None]] = field(default_factory=dict)

    def run(self, name: str) -> dict[str, Any]:
        t = Timer()
        try:
            with t:
                said = self.checks[name]()
        except Exception as e:
            return {"name": name, "status": "unhealthy", "message": str(e), "latency_ms": round(t.ms, 2)}
        return {"name": name, "status": "skipped" if said is None else "healthy", "message": said or "not configured", "latency_ms": round(t.ms, 2)}

    def report(self) -> dict[str, Any]:
        """All checks, and the worst of them: unhealthy if any is."""
        rows = [self.run(n) for n in self.checks]
        return {"status": "unhealthy" if any(r["status"] == "unhealthy" for r in rows) else "healthy", "checks": rows}


class Shutdown:
    """Turns signals into an orderly end: an interrupt asks loops to stop (a second one raises), a termination runs the
    cleanups, last registered first, and exits."""

    def __init__(self) -> None:
        self.asked = threading.Event()
        self._cleanups: list[Callable[[], None]] = []
        self._before: dict[int, Any] = {}

    def register(self, cleanup: Callable[[], None]) -> None:
        self._cleanups.append(cleanup)

    def cleanup(self) -> list[Exception]:
        """Runs each cleanup once; a failing one does not keep the others from running."""
        failed = []
        while self._cleanups:
            try:
                self._cleanups.pop()()
            except Exception as e:
                failed.append(e)
        return failed

    def _interrupted(self, *_: Any) -> None:
        self.asked.set()
        raise KeyboardInterrupt

    def _terminated(self, number: int, *_: Any) -> None:
        self.asked.set()
        self.cleanup()
        raise SystemExit(128 + number)

    def install(self) -> Shutdown:
        for number, f in ((signal.SIGINT, self._interrupted), (signal.SIGTERM, self._terminated)):
            self._before[number] = signal.signal(number, f)
        return self

    def restore(self) -> None:
        for number, f in self._before.items():
            signal.signal(number, f)
        self._before.clear()
