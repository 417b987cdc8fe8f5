"""Fault episodes: interval joins, gating and magnitudes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import clamp


def active_episode(
    events: DataFrame, episodes: DataFrame, time: str = "timestamp", stretch_sec: int = 86_400
) -> DataFrame:
    """Events with the episode whose half-open interval holds them, if any.

    Both sides meet in stretches of time, so it is an equi-join, which needs no broadcast however many
    episodes there are; a short table of them is broadcast by its size.
    """
    at = lambda c: F.floor(F.unix_timestamp(c) / stretch_sec)
    days = F.explode(F.sequence(at("episode_start"), F.greatest(at("episode_start"), at("episode_end"))))
    dealt = episodes.where("episode_start <= episode_end").withColumn("__stretch", days)
    left = events.withColumn("__at", at(time))
    hit = (F.col(time) >= F.col("episode_start")) & (F.col(time) < F.col("episode_end"))
    return left.join(dealt, (F.col("__at") == F.col("__stretch")) & hit, "left").drop("__at", "__stretch")


def gate(windows: DataFrame, offsets: list[tuple[int, int]], base: DataFrame) -> DataFrame:
    """Anomalies only where the window's start, counted from its unit's base time, lies in an episode's offsets."""
    return gate_based(windows.join(base, "ahu_id", "left"), offsets)


def gate_based(windows: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
    """``gate`` where the windows carry their unit's ``base_ts``, as in a stream."""
    since = F.unix_timestamp("start") - F.unix_timestamp("base_ts")
    inside = F.lit(False)
    for a, b in offsets:
        inside |= (since >= a) & (since < b)
    out = windows.withColumn("gated", ~F.coalesce(inside, F.lit(False)))
    return out.withColumn(
        "anomalies", F.when(F.col("gated"), F.filter("anomalies", lambda _: F.lit(False))).otherwise(F.col("anomalies"))
    ).drop("base_ts")


def effective_magnitude(magnitude: Column, ramp_minutes: Column, elapsed_sec: Column) -> Column:
    """Magnitude within 0 and 1, growing linearly over the ramp."""
    base = clamp(magnitude, 0.0, 1.0)
    return F.when(
        ramp_minutes > 0, base * clamp(elapsed_sec / F.nullif(ramp_minutes * 60.0, F.lit(0.0)), 0.0, 1.0)
    ).otherwise(base)


def overlaps(episodes: DataFrame) -> DataFrame:
    """Whether an episode starts before the one before it in its group ends."""
    before = F.lag("episode_end").over(Window.partitionBy("scenario").orderBy("episode_start", "episode_id"))
    return episodes.withColumn("overlaps", F.coalesce(F.col("episode_start") < before, F.lit(False)))


def shift(df: DataFrame, seconds: int, *times: str) -> DataFrame:
    """A timeline moved by so many seconds."""
    return df.withColumns({t: F.col(t) + F.expr(f"INTERVAL {seconds} SECONDS") for t in times})
