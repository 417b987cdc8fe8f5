"""Keyed state with typed variables: windows of each unit, and incidents with their tickets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..config import Config
from ..operators import gating, incidents, rules, summary
from ..operators.windows import STATS, with_cross
from .machine import ROWS_AT_ONCE, UnitMachine

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

COUNTS = ("sample_count", "missing_count", "duplicate_count", "late_count")


def use_rocksdb(df: DataFrame) -> None:
    """Typed state lives in RocksDB; the session keeps a provider of its own, if it sets one."""
    if PROVIDER not in df.sparkSession.conf.getAll:
        df.sparkSession.conf.set(PROVIDER, ROCKS)


class UnitWindows(StatefulProcessor):
    """One unit's windows: a reorder buffer, the keys seen, and mergeable parts of the open window's features.

    A batch reads the state once and writes what changed.  A unit that has sent nothing for ``idle_sec`` by the
    clock of arrivals is flushed by a timer; the keys of windows that can't count any more go with each
    batch or with that timer.
    """

    def __init__(self, signals: tuple[str, ...], size: int, horizon: int, idle_sec: int | None, bounded: bool):
        self.signals, self.size, self.horizon, self.idle, self.bounded = signals, size, horizon, idle_sec, bounded

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.unit = handle.getValueState(
            "unit", "base long, open long, newest long, idle_at long, " + ", ".join(f"{c} long" for c in COUNTS)
        )
        self.seen = handle.getMapState("seen", "window long", "keys array<string>")
        self.waiting = handle.getListState("waiting", "ts long, seq long, values array<double>")
        numbers = "mean m2 low high first last t_mean t_m2 co".split()
        self.parts = handle.getMapState(
            "parts", "signal string", "n long, t_first long, t_last long, " + ", ".join(f"{c} double" for c in numbers)
        )

    def load(self) -> UnitMachine:
        m = UnitMachine(self.size, self.horizon, self.signals)
        if self.unit.exists():
            m.base, m.open, m.newest, self.idle_at, *counts = self.unit.get()
            m.samples, m.missing, m.duplicates, m.late = counts
        else:
            self.idle_at = None
        for (window,), (keys,) in self.seen.iterator():
            m.seen.update(dict.fromkeys(keys, window))
        self.stored = set(m.seen.values())
        m.wait(self.waiting.get())
        m.parts = {signal: list(part) for (signal,), part in self.parts.iterator()}
        return m

    def save(self, m: UnitMachine) -> None:
        m.fold()
        if self.bounded:
            m.forget()
        self.unit.update((m.base, m.open, m.newest, self.idle_at, m.samples, m.missing, m.duplicates, m.late))
        buckets: dict[int, list[str]] = {}
        for k, window in m.seen.items():
            buckets.setdefault(window, []).append(k)
        for window in self.stored - buckets.keys():
            self.seen.removeKey((window,))
        for window in buckets.keys() & (m.touched | (buckets.keys() - self.stored)):
            self.seen.updateValue((window,), (buckets[window],))
        if m.buffer:
            self.waiting.put([(ts, seq, own) for (ts, seq), same in sorted(m.values.items()) for own in same])
        else:
            self.waiting.clear()
        self.parts.clear()
        for signal, part in m.parts.items():
            self.parts.updateValue((signal,), tuple(part))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        m = self.load()
        new = pd.concat(list(rows))
        new = new.sort_values(["seq"] if new["seq"].is_unique else ["seq", "key"], kind="stable")
        values = new[list(self.signals)].to_numpy(float) if self.signals else np.zeros((len(new), 0))
        out: list[tuple] = []
        for ts, seq, k, own in zip(new["ts"], new["seq"], new["key"], values):
            for w in m.flush() if pd.isna(ts) else m.push(int(ts), int(seq), k, own):
                out.append((key[0], *w))
                if len(out) >= ROWS_AT_ONCE:
                    yield self.frame(out)
                    out = []
        if self.idle is not None:
            if self.idle_at is not None:
                self.handle.deleteTimer(self.idle_at)
            self.idle_at = int(new["arrived_ms"].max()) + self.idle * 1000
            self.handle.registerTimer(self.idle_at)
        self.save(m)
        yield self.frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        m = self.load()
        self.idle_at = None
        out = [(key[0], *w) for w in m.flush()]
        self.save(m)
        yield self.frame(out)

    def frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[c.split()[0] for c in window_fields(self.signals)])

    def close(self) -> None:
        pass


def window_fields(signals) -> list[str]:
    return [
        "unit string",
        "window long",
        "base long",
        *(f"{c} long" for c in COUNTS),
        *(f"{s}_{k} double" for s in signals for k in STATS),
    ]


def unit_windows(
    events: DataFrame,
    signals: tuple[str, ...],
    size_sec: int,
    horizon_sec: int,
    idle_sec: int | None = None,
    skew_sec: int = 60,
    bounded: bool = True,
) -> DataFrame:
    """Closed windows of each unit, the empty ones between others too, with counts and features.

    ``events``: unit, ts (microseconds; null ends the unit's stream), seq (order of arrival; equal ones follow key),
    key, the signals, and for ``idle_sec`` the timestamp ``arrived``, which is the clock of timers: it runs on replays
    as it did at first, and only its newest value less ``skew_sec`` is taken for granted.  ``window`` and ``base`` (the
    unit's first window) are in microseconds.
    """
    use_rocksdb(events)
    second = 1_000_000
    d, mode = events, "None"
    if idle_sec is not None:
        d = d.withWatermark("arrived", f"{skew_sec} seconds").withColumn("arrived_ms", F.unix_millis("arrived"))
        mode = "EventTime"
    processor = UnitWindows(tuple(signals), size_sec * second, horizon_sec * second, idle_sec, bounded)
    return d.groupBy("unit").transformWithStateInPandas(processor, ", ".join(window_fields(signals)), "Append", mode)


def exact_summaries(
    events: DataFrame,
    cfg: Config,
    horizon_sec: int | None = None,
    offsets: list[tuple[int, int]] | None = None,
    idle_sec: int | None = None,
    skew_sec: int = 60,
    key: str = "timestamp_text",
) -> DataFrame:
    """Window summaries with exact late and duplicate counts, empty windows, and anomalies gated to ``offsets``.

    ``events`` as ``normalize_events`` gives them, with ``arrival`` (a number) and, for ``idle_sec``, ``arrived``;
    a unit's events with the same ``key`` are duplicates.
    Features come from keyed state; rules, gating and the summary are the batch form's expressions.
    """
    w = cfg.windowing
    if w.kind != "tumbling" or not w.aligned:
        raise ValueError("windows of keyed state are tumbling and aligned")
    d = events.select(
        F.col("ahu_id").alias("unit"),
        F.unix_micros("timestamp").alias("ts"),
        F.col("arrival").cast("long").alias("seq"),
        F.col(key).cast("string").alias("key"),
        *cfg.signals,
        *(["arrived"] if idle_sec is not None else []),
    )
    horizon = cfg.reorder_sec if horizon_sec is None else horizon_sec
    closed = unit_windows(d, tuple(cfg.signals), w.size_sec, horizon, idle_sec, skew_sec)
    wide = closed.select(
        F.col("unit").alias("ahu_id"),
        F.timestamp_micros("window").alias("start"),
        F.timestamp_micros(F.col("window") + w.size_sec * 1_000_000).alias("end"),
        F.timestamp_micros("base").alias("base_ts"),
        *COUNTS,
        *(f"{s}_{k}" for s in cfg.signals for k in STATS),
    )
    found = rules.with_anomalies(with_cross(wide, cfg), cfg)
    if offsets is not None:
        found = gating.gate_based(found, offsets)
    return summary.summaries(found, cfg)


INCIDENT = (
    "seen long, clear long, ticket_id string, status string, pending boolean, occurrence_count long, "
    "refs array<string>, signatures array<string>"
)
CHANGES = (
    "ahu_id string, fault string, window_id string, change string, ticket_id string, occurrence_count long, "
    "diagnose boolean, window_refs array<string>, signatures_seen array<string>, symptom_summary string"
)
OPEN_TICKETS = "ahu_id, detected_fault_type, ticket_id, diagnosis_status, occurrence_count"
#: Windows whose ids and signatures a ticket carries.
REFS = 2


class Incidents(StatefulProcessor):
    """A unit's incidents by fault: streaks, the ticket in hand, a diagnosis under way, and tickets left open."""

    def __init__(self, n_trigger: int, k_clear: int, forced: bool, told: bool):
        self.n, self.k, self.forced, self.waits = n_trigger, k_clear, forced, told

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getMapState("incidents", "fault string", INCIDENT)
        self.open = handle.getMapState("open_tickets", "fault string, ticket_id string", "status string, n long")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for t in initialState.itertuples():
            n = 0 if pd.isna(t.occurrence_count) else int(t.occurrence_count)
            self.open.updateValue((t.detected_fault_type, t.ticket_id), (t.diagnosis_status or "DRAFT", n))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known = {f: dict(zip(NAMES, v)) for (f,), v in self.known.iterator()}
        left = {k: v for k, v in self.open.iterator()}
        before = set(left)
        out: list[tuple] = []
        for r in pd.concat(list(rows)).sort_values(["at", "window_id"], na_position="first").itertuples():
            if r.window_id is None:
                self.told(r, known, left)
            else:
                out.extend((key[0], *change) for change in self.window(r, key[0], known, left))
        for f, st in known.items():
            self.known.updateValue((f,), tuple(st[c] for c in NAMES))
        for k in before - left.keys():
            self.open.removeKey(k)
        for k, v in left.items():
            self.open.updateValue(k, v)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in CHANGES.split(", ")])

    def told(self, r, known: dict, left: dict) -> None:
        """A ticket as it stands elsewhere: open ones can be taken up, a finished diagnosis frees the incident."""
        faults = [r.fault] if r.fault else list(known)
        for f in faults:
            st = known.get(f)
            mine = st is not None and st["ticket_id"] and (not r.ticket_id or r.ticket_id == st["ticket_id"])
            if mine and r.diagnosis_status:
                st["status"], st["pending"] = r.diagnosis_status, r.diagnosis_status == "DIAGNOSING"
            if mine and r.lifecycle_status == "RESOLVED":
                known[f] = fresh()
            elif r.ticket_id and not mine:
                if r.lifecycle_status == "OPEN":
                    left[(f, r.ticket_id)] = (r.diagnosis_status or "DRAFT", 0 if pd.isna(r.n) else int(r.n))
                else:
                    left.pop((f, r.ticket_id), None)

    def window(self, r, unit: str, known: dict, left: dict) -> Iterator[tuple]:
        here = set(r.faults)
        for f in sorted(here | set(known)):
            st = known.setdefault(f, fresh())
            if f in here:
                yield from self.present(r, unit, f, st, left)
            else:
                st["seen"], st["clear"] = 0, st["clear"] + 1
                if st["ticket_id"] and st["clear"] >= self.k:
                    change = "delayed" if st["pending"] else "resolved"
                    yield self.row(r, f, change, st)
                    if change == "resolved":
                        known[f] = fresh()

    def present(self, r, unit: str, fault: str, st: dict, left: dict) -> Iterator[tuple]:
        st["seen"], st["clear"] = st["seen"] + 1, 0
        st["refs"] = [*(st["refs"]), r.window_id][-REFS:]
        st["signatures"] = [*(st["signatures"]), r.signature][-REFS:]
        change = "seen"
        if not st["ticket_id"]:
            mine = sorted(t for f, t in left if f == fault)
            if mine:
                change, st["ticket_id"] = "taken up", mine[0]
                st["status"], st["occurrence_count"] = left.pop((fault, mine[0]))
            elif st["seen"] >= self.n:
                change, st["status"], st["occurrence_count"] = "opened", "DRAFT", 0
                st["ticket_id"] = hashlib.sha256(f"{unit}|{fault}|{r.window_id}".encode()).hexdigest()[:32]
        st["occurrence_count"] += 1
        if st["ticket_id"]:
            draft = st["status"] == "DRAFT" or self.forced
            start = draft and not st["pending"] and st["seen"] >= self.n
            if start:
                st["status"], st["pending"] = "DIAGNOSING", self.waits
            yield self.row(r, fault, change, st, start, r.summary)

    def row(self, r, fault: str, change: str, st: dict, diagnose: bool = False, text: str | None = None) -> tuple:
        refs = (list(st["refs"]), list(st["signatures"])) if text is not None else (None, None)
        return (fault, r.window_id, change, st["ticket_id"], st["occurrence_count"], diagnose, *refs, text)

    def close(self) -> None:
        pass


NAMES = [c.split()[0] for c in INCIDENT.split(", ")]


def fresh() -> dict:
    return dict(zip(NAMES, (0, 0, None, "DRAFT", False, 0, [], [])))


def incident_changes(
    summaries: DataFrame,
    open_tickets: DataFrame | None = None,
    updates: DataFrame | None = None,
    n_trigger: int = 2,
    k_clear: int = 3,
    forced: bool = False,
) -> DataFrame:
    """What each window changes in its unit's tickets, with a ticket's fields as the change leaves them.

    A fault seen in ``n_trigger`` windows in a row opens a ticket; one that has an open ticket (``open_tickets``: the
    table's, as the state starts; or told by ``updates``) takes it up at once.  A diagnosis starts with a draft's
    window that makes ``n_trigger`` in a row (``forced``: of any state), once until it is told to have ended.  At
    ``k_clear`` windows without the fault the ticket is resolved, ``delayed`` while a diagnosis is under way.

    ``updates``: at (the time from which they hold), ahu_id, fault (null: the unit's known ones), ticket_id (null: the
    incident's own), lifecycle_status, diagnosis_status, occurrence_count.  Within a batch windows and updates
    are taken in the order of time, an update before the window that starts then.  Without ``updates`` nothing
    tells that a diagnosis has ended, so none delays a resolution.
    """
    use_rocksdb(summaries)
    none = lambda t: F.lit(None).cast(t)
    d = summaries.select(
        "ahu_id",
        F.col("time.start").alias("at"),
        "window_id",
        "signature",
        F.coalesce("text_summary", F.lit("")).alias("summary"),
        incidents.fault_types(F.col("anomalies")).alias("faults"),
        *(none("string").alias(c) for c in ("fault", "ticket_id", "lifecycle_status", "diagnosis_status")),
        none("long").alias("n"),
    )
    if updates is not None:
        own = "ahu_id at fault ticket_id lifecycle_status diagnosis_status".split()
        told = updates.select(*own, F.col("occurrence_count").alias("n"))
        d = d.unionByName(told, allowMissingColumns=True)
    first = None
    if open_tickets is not None:
        live = open_tickets.where("lifecycle_status = 'OPEN'")
        first = live.select(*OPEN_TICKETS.split(", ")).groupBy("ahu_id")
    processor = Incidents(n_trigger, k_clear, forced, updates is not None)
    return d.groupBy("ahu_id").transformWithStateInPandas(processor, CHANGES, "Append", "None", initialState=first)


def run_to_table(df: DataFrame, at: str) -> DataFrame:
    """Runs a stream over what its source has now, into a parquet folder below ``at``; the rows read again."""
    spark = df.sparkSession
    q = df.writeStream.format("parquet").option("checkpointLocation", f"{at}/state").trigger(availableNow=True)
    q.start(f"{at}/out").awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{at}/out")
