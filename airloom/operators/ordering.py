"""Deduplication, reorder horizon, late and duplicate accounting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_arrivals(df: DataFrame, key: list[str], arrival: str) -> DataFrame:
    """The first arrival of each key."""
    w = Window.partitionBy(*key).orderBy(arrival)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def running_watermark(
    df: DataFrame, unit: str, time: str, arrival: str, horizon_sec: int, block_rows: int = 1_000_000
) -> DataFrame:
    """Each unit's watermark after every arrival (a number): the latest time so far less the horizon."""
    block = F.coalesce(F.floor(F.col(arrival) / block_rows), F.lit(-(1 << 62)))
    d = running(df, unit, block, [arrival], F.col(time), F.max, frame="here")
    return d.select(*df.columns, (F.col("running") - F.expr(f"INTERVAL {horizon_sec} SECONDS")).alias("watermark"))


def gaps(
    df: DataFrame,
    unit: str = "ahu_id",
    time: str = "timestamp",
    ties: tuple[str, ...] = (),
    block_sec: int = 30 * 86_400,
) -> DataFrame:
    """``gap_s``: seconds since the unit's row before; null for its first.  Rows of one time follow ``ties``.

    In the order of time the row before has the latest time so far, so a unit's rows are cut into blocks of time.
    """
    block = F.coalesce(F.floor(F.unix_timestamp(time) / block_sec), F.lit(-(1 << 62)))
    d = running(df, unit, block, [time, *ties], F.col(time), F.max)
    return d.select(*df.columns, ((F.unix_micros(time) - F.unix_micros("running")) / 1e6).alias("gap_s"))


def replay_schedule(df: DataFrame, speed: float = 1.0, time: str = "timestamp") -> DataFrame:
    """``due_s``: when a replay sends each row, in seconds after its start; speed 0 sends all at once."""
    first = df.agg(F.min(time).alias("__first"))
    since = (F.unix_micros(time) - F.unix_micros("__first")) / 1e6
    due = since / speed if speed > 0 else F.lit(0.0)
    return df.join(F.broadcast(first)).withColumn("due_s", due).drop("__first")


def running(
    df: DataFrame, key: str, block: Column, order: list, value: Column, how=F.max, down: bool = False, frame: str = "rows"
) -> DataFrame:
    """``df`` with ``running``: the extreme (or sum) of ``value`` over a key's rows before each row in ``order``.

    A key's rows are cut into blocks that follow the order; a block starts from the extreme of the blocks
    before it, of which there is one row each, so a key with very many rows is spread over tasks.  ``frame``
    says which rows of the own block count: "rows" those before the row, "here" that and the row itself,
    "ties" all up to the row's order value.  ``down``: the order, and so that of the blocks, descends.
    """
    d = df.withColumn("__b", block)
    turn = F.desc if down else F.asc
    per = d.groupBy(key, "__b").agg(how(value).alias("__m"))
    earlier = Window.partitionBy(key).orderBy(turn("__b")).rowsBetween(Window.unboundedPreceding, -1)
    start = per.select(key, "__b", how("__m").over(earlier).alias("__start"))
    own = Window.partitionBy(key, "__b").orderBy(*[turn(c) for c in order])
    own = {
        "rows": own.rowsBetween(Window.unboundedPreceding, -1),
        "here": own.rowsBetween(Window.unboundedPreceding, 0),
        "ties": own.rangeBetween(Window.unboundedPreceding, 0),
    }[frame]
    out = d.withColumn("__own", how(value).over(own)).join(start, [key, "__b"])
    if how is F.sum:
        both = F.coalesce("__own", F.lit(0)) + F.coalesce("__start", F.lit(0))
    else:
        both = (F.greatest if how is F.max else F.least)("__own", "__start")
    return out.withColumn("running", both).drop("__b", "__own", "__start")


def account(
    df: DataFrame, size_sec: int, horizon_sec: int, block_rows: int = 1_000_000, block_sec: int = 30 * 86_400
) -> DataFrame:
    """The fate of every arrival (unit, ts_s, seq, key): dup, late, and the window it counts in.

    Duplicates pass at once and move windows on; others are released when the watermark covers them,
    in time order, or at the end.  A release behind the open window is late and counts there.  A row is
    released by the first arrival whose time is the horizon ahead: a running minimum over times in
    descending order instead of a self join.  Arrivals are cut into blocks of ``block_rows`` arrival
    numbers, times into blocks of ``block_sec`` seconds (see ``running``), so no task holds a unit's whole
    history.
    """
    by_time = F.floor(F.col("v") / block_sec)
    d = df.withColumn("dup", F.row_number().over(Window.partitionBy("unit", "key").orderBy("seq")) > 1)
    none = F.lit(None).cast("long")
    points = d.where("NOT dup").select("unit", F.col("ts_s").alias("v"), F.col("seq").alias("ms"), none.alias("qs"))
    ahead = (F.col("ts_s") + horizon_sec).alias("v")
    asked = d.where("NOT dup").select("unit", ahead, none.alias("ms"), F.col("seq").alias("qs"))
    found = running(points.unionByName(asked), "unit", by_time, ["v"], F.col("ms"), F.min, down=True, frame="ties")
    found = found.where("qs IS NOT NULL").select("unit", F.col("qs").alias("seq"), F.col("running").alias("fs"))
    released = F.greatest("seq", F.coalesce("fs", F.lit(10**18)))
    r = d.join(found, ["unit", "seq"], "left").withColumn("rel", F.when(F.col("dup"), F.col("seq")).otherwise(released))
    floor = F.col("ts_s") - F.pmod("ts_s", F.lit(size_sec))
    p = running(r, "unit", F.floor(F.col("rel") / block_rows), ["rel", "ts_s", "seq"], floor)
    late = F.coalesce(F.col("ts_s") < F.col("running"), F.lit(False))
    window = F.when(late, F.col("running")).otherwise(floor)
    return p.select(*df.columns, "dup", late.alias("late"), window.alias("window_s"))


def window_accounts(accounted: DataFrame) -> DataFrame:
    """sample, duplicate and late counts for each unit and window."""
    return accounted.groupBy("unit", "window_s").agg(
        F.count_if(~F.col("dup") & ~F.col("late")).alias("sample_count"),
        F.count_if(F.col("dup") & ~F.col("late")).alias("duplicate_count"),
        F.count_if("late").alias("late_count"),
    )
