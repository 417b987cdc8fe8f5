"""Streaming twins of the batch operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..operators import rules, summary, windows
from ..operators.normalize import normalize_events, normalize_windows, parse_json
from ..sources.readers import SUMMARY_SCHEMA
from .machine import WindowMachine  # noqa: F401
from .state import incident_changes, unit_windows


def events_from_json(values: DataFrame, cfg: Config = Config()) -> DataFrame:
    return normalize_events(parse_json(values), cfg)


def window_events(values: DataFrame, value: str = "value") -> DataFrame:
    """Valid window summaries of a stream's (or table's) JSON values; others are dropped."""
    parsed = F.from_json(F.col(value).cast("string"), SUMMARY_SCHEMA)
    return normalize_windows(values.select(parsed.alias("w")).where("w IS NOT NULL").select("w.*"))


def start(
    df: DataFrame,
    write: Callable[[DataFrame, int], None],
    checkpoint: str,
    interval_sec: float | None = None,
    until_idle: bool = False,
):
    """Run a stream into a batch writer: every ``interval_sec`` at most, and with ``until_idle`` until it has caught up.

    The position is committed after the writer has returned, and a batch that is repeated after a failure has
    the same number, by which writers in ``sources.sinks`` know it.
    """
    w = df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    if until_idle:
        w = w.trigger(availableNow=True)
    elif interval_sec:
        w = w.trigger(processingTime=f"{max(1, round(interval_sec * 1000))} milliseconds")
    return w.start()


def window_summaries(events: DataFrame, cfg: Config, horizon_sec: int | None = None) -> DataFrame:
    """Summaries of windows as the watermark closes them, with bounded state.

    The same expressions as the batch form; duplicates are dropped within the watermark's horizon.
    The watermark is one for all units; ``account`` keeps one for each.
    """
    horizon = cfg.reorder_sec if horizon_sec is None else horizon_sec
    once = events.withWatermark(
        "timestamp", f"{horizon} seconds"
    ).dropDuplicatesWithinWatermark(["ahu_id", "timestamp_text"])
    return summary.summaries(rules.with_anomalies(windows.windowed(once, cfg), cfg), cfg)


def account(events: DataFrame, size_sec: int, horizon_sec: int, bounded: bool = True) -> DataFrame:
    """(unit, window_s, sample_count, duplicate_count, late_count) of closed windows, with a watermark for each unit.

    Events have unit, ts_s, seq and key; a null ts_s ends the unit's stream; see ``unit_windows``.
    """
    d = events.select("unit", (F.col("ts_s") * 1_000_000).alias("ts"), "seq", "key")
    closed = unit_windows(d, (), size_sec, horizon_sec, bounded=bounded)
    window = F.expr("`window` DIV 1000000").alias("window_s")
    return closed.select("unit", window, "sample_count", "duplicate_count", "late_count")


def ticket_changes(summaries: DataFrame, n_trigger: int = 2, k_clear: int = 3) -> DataFrame:
    """(ahu_id, fault, window_id, change, occurrence_count): tickets opened, seen again and resolved.

    See ``incident_changes``, which gives tickets' fields as well.
    """
    found = incident_changes(summaries, n_trigger=n_trigger, k_clear=k_clear)
    return found.select("ahu_id", "fault", "window_id", "change", "occurrence_count")
