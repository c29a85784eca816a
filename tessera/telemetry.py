"""Counters, histograms and gauges of a process, as a dict or in the text format that scrapers read."""

from __future__ import annotations

import bisect
import contextlib
import hashlib
import logging
import threading
import time
from collections.abc import Iterator

SLOW_MS = 200
BUCKETS = tuple(m * 10.0**e for e in range(-3, 1) for m in (1, 2, 5)) + (10.0,)
log = logging.getLogger("tessera")


class Telemetry:
    def __init__(self) -> None:
        self._lock = threading.Lock()
        self._counters: dict[tuple, float] = {}
        self._gauges: dict[str, float] = {}
        self._histograms: dict[tuple, list] = {}

    def count(self, name: str, by: float = 1, **labels: str) -> None:
        key = name, tuple(sorted(labels.items()))
        with self._lock:
            self._counters[key] = self._counters.get(key, 0) + by

    def observe(self, name: str, seconds: float, **labels: str) -> None:
        key = name, tuple(sorted(labels.items()))
        with self._lock:
            held = self._histograms.setdefault(key, [[0] * (len(BUCKETS) + 1), 0.0])
            held[0][bisect.bisect_left(BUCKETS, seconds)] += 1
            held[1] += seconds

    def gauge(self, name: str, value: float) -> None:
        with self._lock:
            self._gauges[name] = value

    @contextlib.contextmanager
    def stage(self, name: str) -> Iterator[None]:
        start = time.perf_counter()
        try:
            yield
        finally:
            self.observe("stage_seconds", time.perf_counter() - start, stage=name)

    def request(self, mode: str, outcome: str, seconds: float, query: str) -> None:
        """One search; a slow one is logged without its text."""
        self.count("requests", mode=mode, outcome=outcome)
        self.observe("request_seconds", seconds, mode=mode)
        if seconds * 1000 > SLOW_MS:
            log.info("slow query %s", {"query_sha256": hashlib.sha256(query.encode()).hexdigest(), "mode": mode, "ms": round(seconds * 1000, 1)})

    def index(self, stats: dict) -> None:
        """Gauges of an index from its ``stats()``."""
        self.gauge("index_bytes", stats["bytes"])
        self.gauge("live_documents", stats["live_documents"])
        self.gauge("pending_revisions", stats["durable_revision"] - stats["visible_revision"])

    def text(self) -> str:
        show = lambda labels: "{" + ",".join(f'{k}="{v}"' for k, v in labels) + "}" if labels else ""
        with self._lock:
            lines = [f"tessera_{n}_total{show(la)} {v}" for (n, la), v in sorted(self._counters.items())]
            lines += [f"tessera_{n} {v}" for n, v in sorted(self._gauges.items())]
            for (n, la), (counts, total) in sorted(self._histograms.items()):
                seen = 0
                for bound, c in zip((*BUCKETS, float("inf")), counts):
                    seen += c
                    lines.append(f"tessera_{n}_bucket{show((*la, ('le', '+Inf' if bound == float('inf') else f'{bound:g}')))} {seen}")
                lines += [f"tessera_{n}_sum{show(la)} {total}", f"tessera_{n}_count{show(la)} {seen}"]
        return "\n".join(lines) + "\n"
