"""Event-time windows with all signal features in one aggregate."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config

STATS = ("mean", "var", "min", "max", "delta", "slope")


def stat(signal: str, name: str, time: Column, start: Column) -> Column:
    """One feature of a signal over a group; null where it isn't defined (no value, or fewer than two for delta and slope)."""
    v = F.col(signal)
    at = F.when(v.isNotNull(), time)
    minutes = (F.unix_micros(time) - F.unix_micros(start)) / 60e6
    return {
        "mean": lambda: F.avg(v),
        "var": lambda: F.var_pop(v),
        "min": lambda: F.min(v),
        "max": lambda: F.max(v),
        "delta": lambda: F.when(F.count(v) >= 2, F.max_by(v, at) - F.min_by(v, at)),
        "slope": lambda: F.when(F.count(v) >= 2, F.regr_slope(v, minutes)),
    }[name]()


def cross_feature(expr: str) -> Column:
    """``a - b`` or ``a + b`` over features."""
    m = re.fullmatch(r"\s*(\w+)\s*([+-])\s*(\w+)\s*", expr)
    if not m:
        raise ValueError(f"not a sum or difference of two features: {expr}")
    a, b = F.col(m[1]), F.col(m[3])
    return a + b if m[2] == "+" else a - b


def windowed(events: DataFrame, cfg: Config, stats: tuple[str, ...] = STATS) -> DataFrame:
    """ahu_id, start, end, sample_count, missing_count and ``{signal}_{stat}`` columns, then cross features.

    Works on batch and streaming events alike: a single partial aggregate and one exchange on unit and
    window.  Slopes are per minute since the window's start.
    """
    w = cfg.windowing
    ts = F.col("timestamp")
    win = F.window(
        ts, f"{w.size_sec} seconds", f"{w.step_sec} seconds"
    ) if w.kind == "sliding" else F.window(ts, f"{w.size_sec} seconds")
    e = events.withColumn("window", win).withColumn("__start", F.col("window.start"))
    missing = sum((F.col(s).isNull().cast("int") for s in cfg.signals), F.lit(0))
    aggs = [stat(s, k, ts, F.col("__start")).alias(f"{s}_{k}") for s in cfg.signals for k in stats]
    out = e.groupBy("ahu_id", "window").agg(
        F.count("*").alias("sample_count"), F.sum(missing).alias("missing_count"), *aggs
    )
    out = out.select(
        "ahu_id",
        F.col("window.start").alias("start"),
        F.col("window.end").alias("end"),
        *[c for c in out.columns if c not in ("ahu_id", "window")],
    )
    return with_cross(out, cfg)


def with_cross(df: DataFrame, cfg: Config) -> DataFrame:
    fit = {n: e for n, e in cfg.cross.items() if all(x in df.columns for x in re.findall(r"\w+", e))}
    return df.withColumns({n: cross_feature(e) for n, e in fit.items()}) if fit else df


def unaligned_start(events: DataFrame, size_sec: int) -> DataFrame:
    """``start`` counted from each unit's first event instead of the epoch."""
    first = events.groupBy("ahu_id").agg(F.min(F.unix_timestamp("timestamp")).alias("__first"))
    s = F.unix_timestamp("timestamp")
    return events.join(first, "ahu_id").withColumn(
        "start", F.timestamp_seconds(s - F.pmod(s - F.col("__first"), F.lit(size_sec)))
    ).drop("__first")


def fill_gaps(windows: DataFrame, size_sec: int) -> DataFrame:
    """Empty windows between a unit's first and last, with counts of zero."""
    step = f"INTERVAL {size_sec} SECONDS"
    nxt = F.lead("start").over(Window.partitionBy("ahu_id").orderBy("start"))
    gaps = windows.select("ahu_id", "end", nxt.alias("next")).where("next > end")
    gaps = gaps.select("ahu_id", F.explode(F.expr(f"sequence(end, next - {step}, {step})")).alias("start"))
    gaps = gaps.withColumn("end", F.col("start") + F.expr(step)).withColumns(
        {c: F.lit(0).cast("long") for c in ("sample_count", "missing_count") if c in windows.columns}
    )
    return windows.unionByName(gaps, allowMissingColumns=True)


def feature_map(df: DataFrame, cfg: Config) -> Column:
    """Features that are there, as a map."""
    names = [f"{s}_{k}" for s in cfg.signals for k in STATS] + list(cfg.cross)
    names = [n for n in names if n in df.columns]
    return F.map_filter(
        F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*map(F.col, names))), lambda _, v: v.isNotNull()
    )
