"""Counters, histograms and spans of jobs, steps and chunks, kept on the driver."""

from __future__ import annotations

import threading
import time
from collections import defaultdict
from contextlib import contextmanager


class Telemetry:
    """Cheap when nobody listens: a listener gets (kind, name, value, tags)."""

    def __init__(self) -> None:
        self.counters: dict[str, float] = defaultdict(float)
        self.histograms: dict[str, list[float]] = defaultdict(list)
        self.spans: list[tuple[str, dict, float]] = []
        self._listeners: list = []
        self._lock = threading.Lock()

    def listen(self, listener) -> None:
        self._listeners.append(listener)

    def _tell(self, kind: str, name: str, value: float, tags: dict) -> None:
        for x in self._listeners:
            x(kind, name, value, tags)

    def add(self, name: str, value: float = 1, **tags: object) -> None:
        with self._lock:
            self.counters[name] += value
        self._tell("counter", name, value, tags)

    def record(self, name: str, value: float, **tags: object) -> None:
        with self._lock:
            self.histograms[name].append(value)
        self._tell("histogram", name, value, tags)

    @contextmanager
    def span(self, name: str, **tags: object):
        began = time.perf_counter()
        try:
            yield
        finally:
            ms = (time.perf_counter() - began) * 1000
            with self._lock:
                self.spans.append((name, tags, ms))
            self._tell("span", name, ms, tags)


TELEMETRY = Telemetry()
