"""Plain state machines of one unit: event by event, as tests and keyed state use them."""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np

#: Closed windows go on in frames of so many rows.
ROWS_AT_ONCE = 50_000


class WindowMachine:
    """One unit's reorder buffer and open window, event by event.

    Duplicates pass the buffer and may move windows on; an event behind the open window is late and
    counts there; windows without events between others are closed too; ``flush`` ends the stream.
    Closed windows come one by one, so that a jump in time needs no list of the empty ones.
    """

    def __init__(self, size: int, horizon: int):
        self.size, self.horizon = size, horizon
        self.seen: dict[str, int] = {}
        self.buffer: list[tuple[int, int]] = []  # a heap
        self.newest: int | None = None
        self.open: int | None = None
        self.samples = self.duplicates = self.late = 0

    def push(self, ts: int, seq: int, key: str) -> Iterator[tuple]:
        if key in self.seen:
            yield from self._place(ts, None)
            return
        self.seen[key] = ts - ts % self.size
        heapq.heappush(self.buffer, (ts, seq))
        self.newest = ts if self.newest is None else max(self.newest, ts)
        while self.buffer and self.buffer[0][0] <= self.newest - self.horizon:
            yield from self._place(*heapq.heappop(self.buffer))

    def flush(self) -> Iterator[tuple]:
        while self.buffer:
            yield from self._place(*heapq.heappop(self.buffer))
        if self.open is not None and (self.samples or self.duplicates or self.late):
            yield self._close()

    def _place(self, ts: int, seq: int | None) -> Iterator[tuple]:
        """Count an event (seq null: a duplicate) in its window, or as late in the open one."""
        w = ts - ts % self.size
        if self.open is None:
            self.open = w
        if w < self.open:
            self.late += 1
            if seq is not None:
                self._drop(ts, seq)
            return
        while self.open < w:
            yield self._close()
        if seq is None:
            self.duplicates += 1
        else:
            self.samples += 1
            self._take(ts, seq)

    def _take(self, ts: int, seq: int) -> None:
        """An event enters the open window."""

    def _drop(self, ts: int, seq: int) -> None:
        """A late event leaves."""

    def _close(self) -> tuple:
        closed = (self.open, self.samples, self.duplicates, self.late)
        self.open, self.samples, self.duplicates, self.late = self.open + self.size, 0, 0, 0
        return closed

    def forget(self) -> None:
        """Drop keys of windows behind the open one and the horizon: whatever repeats them is late, known or not."""
        if self.open is not None:
            done = min(self.open, self.newest - self.horizon) - self.size
            self.seen = {k: w for k, w in self.seen.items() if w > done}


class UnitMachine(WindowMachine):
    """A WindowMachine that folds the open window's values into parts that merge, one for each signal."""

    def __init__(self, size: int, horizon: int, signals: tuple[str, ...]):
        super().__init__(size, horizon)
        self.signals = signals
        self.base: int | None = None
        self.missing = 0
        self.values: dict[tuple[int, int], list[list[float]]] = {}  # of events in the buffer, by time and arrival
        self.taken: list[tuple[int, list[float]]] = []
        self.parts: dict[str, list] = {}
        self.touched: set[int] = set()  # windows with new keys

    def wait(self, rows: Iterable[tuple]) -> None:
        """Events that were in the buffer before."""
        for ts, seq, values in rows:
            self.buffer.append((ts, seq))
            self.values.setdefault((ts, seq), []).append(list(values))
        heapq.heapify(self.buffer)

    def push(self, ts: int, seq: int, key: str, values=()) -> Iterator[tuple]:
        if self.base is None:
            self.base = ts - ts % self.size
        if key not in self.seen:
            self.values.setdefault((ts, seq), []).append([float(v) for v in values])
            self.touched.add(ts - ts % self.size)
        yield from super().push(ts, seq, key)

    def _take(self, ts: int, seq: int) -> None:
        own = self._values(ts, seq)
        self.missing += sum(v != v for v in own)
        self.taken.append((ts, own))

    def _drop(self, ts: int, seq: int) -> None:
        self._values(ts, seq)

    def _values(self, ts: int, seq: int) -> list[float]:
        """The values of the first that waits of a time and arrival."""
        own = self.values[ts, seq].pop(0)
        if not self.values[ts, seq]:
            del self.values[ts, seq]
        return own

    def fold(self) -> None:
        """Merge the parts of events taken since the last time."""
        if not self.taken or not self.signals:
            self.taken.clear()
            return
        at = np.array([t for t, _ in self.taken], np.int64)
        values = np.array([v for _, v in self.taken], float)
        minutes = (at - self.open) / 60e6
        for j, signal in enumerate(self.signals):
            there = ~np.isnan(values[:, j])
            if there.any():
                part = summed(at[there], minutes[there], values[there, j])
                self.parts[signal] = merged(self.parts[signal], part) if signal in self.parts else part
        self.taken.clear()

    def _close(self) -> tuple:
        self.fold()
        stats = [v for s in self.signals for v in features(self.parts.get(s))]
        window, samples, duplicates, late = super()._close()
        row = (window, self.base, samples, self.missing, duplicates, late, *stats)
        self.parts, self.missing = {}, 0
        return row


def summed(at: np.ndarray, minutes: np.ndarray, v: np.ndarray) -> list:
    """[n, t_first, t_last, mean, m2, low, high, first, last, t_mean, t_m2, co] of values at times."""
    first, last = int(at.argmin()), len(at) - 1 - int(at[::-1].argmax())
    mean, t_mean = float(v.mean()), float(minutes.mean())
    dv, dt = v - mean, minutes - t_mean
    ends = (float(v.min()), float(v.max()), float(v[first]), float(v[last]))
    spread = (t_mean, float(dt @ dt), float(dv @ dt))
    return [len(v), int(at[first]), int(at[last]), mean, float(dv @ dv), *ends, *spread]


def merged(a: list, b: list) -> list:
    n = a[0] + b[0]
    f, d, dt = a[0] * b[0] / n, b[3] - a[3], b[9] - a[9]
    first, last = (a if a[1] <= b[1] else b), (a if a[2] > b[2] else b)
    ends = (min(a[5], b[5]), max(a[6], b[6]), first[7], last[8])
    spread = (a[9] + dt * b[0] / n, a[10] + b[10] + dt * dt * f, a[11] + b[11] + d * dt * f)
    return [n, first[1], last[2], a[3] + d * b[0] / n, a[4] + b[4] + d * d * f, *ends, *spread]


def features(p: list | None) -> tuple:
    """mean, var, min, max, delta, slope, as the batch aggregates define them."""
    if p is None:
        return (None,) * 6
    several = p[0] >= 2
    slope = p[11] / p[10] if several and p[10] > 0 else None
    return p[3], p[4] / p[0], p[5], p[6], p[8] - p[7] if several else None, slope
