"""What an instrumented program needs: a tracer that makes wire events, and exporters that take them."""

from __future__ import annotations

import json
import os
import threading
import time
import urllib.request
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from spanloom.functions.ids import EVENT_TYPES

EPOCH_MS = 1_600_000_000_000


class SnowflakeIds:
    """Rising ids of 41 bits of milliseconds, 10 bits of node and 12 bits of sequence. A clock that steps back is waited for in the sequence."""

    def __init__(self, node: int = 0, clock: Callable[[], float] = time.time):
        self.node, self.clock = node & 1023, clock
        self._last, self._seq, self._lock = -1, 0, threading.Lock()

    def __call__(self) -> int:
        with self._lock:
            now = max(int(self.clock() * 1000) - EPOCH_MS, self._last)
            self._seq = self._seq + 1 & 4095 if now == self._last else 0
            if now == self._last and not self._seq:
                now += 1
            self._last = now
            return now << 22 | self.node << 12 | self._seq


class Collecting:
    """Keeps events in memory."""

    def __init__(self):
        self.events: list[dict] = []

    def export(self, event: dict) -> None:
        self.events.append(event)

    def close(self) -> None:
        pass


class Console(Collecting):
    """Prints events as they come."""

    def export(self, event: dict) -> None:
        print(json.dumps(event, ensure_ascii=False))


class Batch:
    """Passes events on in batches of ``size``, the rest at the end."""

    def __init__(self, send: Callable[[list[dict]], None], size: int = 256):
        self.send, self.size = send, size
        self._held: list[dict] = []
        self._lock = threading.Lock()

    def export(self, event: dict) -> None:
        with self._lock:
            self._held.append(event)
            full, self._held = (self._held, []) if len(self._held) >= self.size else ([], self._held)
        if full:
            self.send(full)

    def close(self) -> None:
        with self._lock:
            rest, self._held = self._held, []
        if rest:
            self.send(rest)


class Folder(Batch):
    """A file for each batch, one JSON array on a line, in a folder that a stream watches. A file appears whole."""

    def __init__(self, folder: str, size: int = 256):
        self.folder = Path(folder)
        self.folder.mkdir(parents=True, exist_ok=True)
        super().__init__(self._put, size)

    def _put(self, events: list[dict]) -> None:
        draft = self.folder / f".{uuid.uuid4().hex}"
        draft.write_text(json.dumps(events, ensure_ascii=False) + "\n")
        os.rename(draft, self.folder / f"{time.time_ns()}-{draft.name[1:]}.json")


class Http(Batch):
    """Posts batches to a service."""

    def __init__(self, url: str, token: str | None = None, size: int = 256, timeout: float = 10):
        self.url, self.token, self.timeout = url, token, timeout
        super().__init__(self._post, size)

    def _post(self, events: list[dict]) -> None:
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.token}"} if self.token else {})
        with urllib.request.urlopen(urllib.request.Request(self.url, json.dumps(events).encode(), headers), timeout=self.timeout):
            pass


class Span:
    """A step of a trace. Values set on it go out with its end."""

    def __init__(self, tracer: Tracer, trace_id: int, parent: Span | None, name: str, values: dict):
        self.tracer, self.trace_id, self.parent, self.name, self.values = tracer, trace_id, parent, name, values
        self.span_id, self.seq, self.status, self.began = tracer.ids(), 0, 0, tracer.now()
        self.session_id = values.get("session_id", parent.session_id if parent else None)

    def _emit(self, kind: str, **values) -> None:
        self.seq += 1
        event = {"trace_id": self.trace_id, "span_id": self.span_id, "ts": self.tracer.now(), "seq": self.seq, "event_type": EVENT_TYPES[kind], "ext_span_id": f"{self.trace_id}-{self.span_id}", **values}
        self.tracer.exporter.export({k: v for k, v in event.items() if v is not None})

    def set(self, **values) -> Span:
        self.values |= values
        return self

    def log(self, line: str) -> None:
        self._emit("log", logs=[line])

    @contextmanager
    def span(self, name: str, **values) -> Iterator[Span]:
        with self.tracer._run(Span(self.tracer, self.trace_id, self, name, values)) as s:
            yield s


class Tracer:
    def __init__(self, exporter, tenant_id: int | None = None, ids: Callable[[], int] | None = None, now: Callable[[], int] = time.time_ns):
        self.exporter, self.tenant_id, self.ids, self.now = exporter, tenant_id, ids or SnowflakeIds(os.getpid()), now

    @contextmanager
    def trace(self, name: str, **values) -> Iterator[Span]:
        """The root span of a new trace."""
        with self._run(Span(self, self.ids(), None, name, values)) as s:
            yield s

    @contextmanager
    def _run(self, span: Span) -> Iterator[Span]:
        span._emit("start", logs=[span.name], parent_span_id=span.parent.span_id if span.parent else None, session_id=span.session_id, tenant_id=self.tenant_id, **{k: v for k, v in span.values.items() if k != "session_id"})
        span.values = {}
        try:
            yield span
        except BaseException:
            span.status = 1
            raise
        finally:
            span._emit("end", duration_ns=max(0, self.now() - span.began), **({"status": span.status} | span.values))
