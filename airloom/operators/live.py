"""Serving queries over telemetry and windows, each with an explicit as-of time (2.15)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import is_window_evidence, iso_z, severity_rank
from .ordering import running


def latest(df: DataFrame, key: str, time: str, value: list[str]) -> DataFrame:
    """The latest row of each key."""
    last = F.max_by(F.struct(*value), F.col(time)).alias("v")
    return df.groupBy(key).agg(F.max(time).alias(time), last).select(key, time, "v.*")


def last_n(df: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)


def online(time: Column, as_of: Column, threshold_sec: int = 15) -> Column:
    return F.unix_timestamp(as_of) - F.unix_timestamp(time) <= threshold_sec


def retain(df: DataFrame, key: str, time: str, minutes: int) -> DataFrame:
    """Rows no older than so many minutes before their key's newest."""
    newest = df.groupBy(F.col(key).alias("__k")).agg(F.max(time).alias("__newest"))
    return df.join(newest, F.col(key) == F.col("__k")).where(
        F.col(time) >= F.col("__newest") - F.expr(f"INTERVAL {minutes} MINUTES")
    ).drop("__k", "__newest")


def downsample(df: DataFrame, key: str, time: list[str], most: int, block_sec: int = 30 * 86_400) -> DataFrame:
    """Every k-th row of each key and its last one, about ``most`` rows.

    Rows are numbered by blocks of time, so a key with a long history is spread over tasks.
    """
    counts = df.groupBy(key).agg(F.count("*").alias("__n"))
    block = F.coalesce(F.floor(F.col(time[0]).cast("double") / block_sec), F.lit(-(1 << 62)))
    rows = running(df, key, block, time, F.lit(1), F.sum).withColumnRenamed("running", "__i").join(counts, key)
    step = F.when(F.col("__n") <= most, 1).otherwise(F.ceil(F.col("__n") / most))
    kept = rows.where((F.pmod(F.col("__i"), step) == 0) | (F.col("__i") == F.col("__n") - 1))
    return kept.select(*df.columns)


def in_range(df: DataFrame, time: str, start: str, end: str) -> DataFrame:
    """Rows of a closed time range."""
    return df.where(F.col(time).between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))


def time_range(df: DataFrame, key: str, unit: str, time: str, start: str, end: str, signals: list[str]) -> DataFrame:
    """A unit's rows of a closed time range, with the signals asked for."""
    return in_range(df.where(F.col(key) == unit), time, start, end).select(iso_z(F.col(time)).alias("ts"), *signals)


# Names that the serving side accepts for a signal; the first that a unit's newest row has counts.
ALIASES = {
    "sat": ("sat", "sat_c", "sa_temp", "sa_temp_c"),
    "rat": ("rat", "rat_c", "ra_temp", "ra_temp_c", "avg_zone_temp", "avg_zone_temp_c"),
    "valve_pos": ("valve_pos", "cc_valve", "cc_valve_pos", "cc_valve_pct"),
    "fan_speed": ("fan_speed", "sa_fan_speed", "sa_fan_speed_pct", "fan_speed_pct"),
    "damper_pos": ("damper_pos", "oa_damper", "oa_damper_pos", "oa_damper_pct"),
    "oat": ("oat", "oat_c", "oa_temp", "oa_temp_c", "outdoor_air_temp", "outdoor_air_temp_c"),
}
# Limits of the serving side.
MOST_MINUTES, MOST_POINTS, MOST_ROWS, KEPT_WINDOWS = 120, 2000, 200, 500


def names_of(name: str) -> tuple[str, ...]:
    return ALIASES.get(name, (name,))


def pick(df: DataFrame, name: str) -> Column:
    """A row's value under the first of a name's columns that isn't null."""
    found = [F.col(c) for c in names_of(name) if c in df.columns]
    return F.coalesce(*found) if found else F.lit(None)


def resolved(df: DataFrame, names: list[str], unit: str = "ahu_id", time: str = "timestamp") -> DataFrame:
    """A row per unit: the time of its newest row, and for each name the column that this row has a value in."""
    there = {n: [c for c in names_of(n) if c in df.columns] for n in names}
    used = sorted({c for cs in there.values() for c in cs})
    newest = df.groupBy(unit).agg(F.max_by(F.struct(F.col(time).alias("newest"), *used), F.col(time)).alias("__v"))
    value = lambda c: F.col(f"__v.{c}")
    keys = [
        F.coalesce(*[F.when(value(c).isNotNull(), F.lit(c)) for c in there[n]], F.lit(None).cast("string")).alias(n)
        for n in names
    ]
    return newest.select(unit, F.col("__v.newest").alias("newest"), F.struct(*keys).alias("keys"))


def _renamed(df: DataFrame, names: list[str]) -> list[Column]:
    """Each name's value, read from the column that ``keys`` says."""
    out = []
    for n in names:
        value = F.lit(None).cast("double")
        for c in names_of(n):
            if c in df.columns:
                value = F.when(F.col("keys")[n] == c, F.col(c).cast("double")).otherwise(value)
        out.append(value.alias(n))
    return out


def timeseries(df: DataFrame, minutes: int, names: list[str], as_of: str, most_points: int = MOST_POINTS) -> DataFrame:
    """Each unit's last minutes under the names asked for, in about ``most_points`` rows.

    Where a unit's newest row is older than the range, the range ends there instead.  A name means the
    same column in all of a unit's rows, the one that its newest row has.
    """
    span = F.expr(f"INTERVAL {min(minutes, MOST_MINUTES)} MINUTES")
    now = F.lit(as_of).cast("timestamp")
    until = F.when(F.col("newest") < now - span, F.col("newest")).otherwise(now)
    rows = df.join(resolved(df, names).withColumn("until", until), "ahu_id")
    rows = rows.where(F.col("timestamp").between(F.col("until") - span, F.col("until")))
    thin = downsample(rows, "ahu_id", ["timestamp"], most_points)
    return thin.select("ahu_id", iso_z(F.col("timestamp")).alias("ts"), *_renamed(thin, names))


def last_points(df: DataFrame, n: int, names: list[str], most_points: int = MOST_POINTS) -> DataFrame:
    """Each unit's newest rows under the names asked for."""
    rows = last_n(df, "ahu_id", ["timestamp"], min(n, most_points)).join(resolved(df, names), "ahu_id")
    return rows.select("ahu_id", iso_z(F.col("timestamp")).alias("ts"), "rn", *_renamed(rows, names))


def max_severity(anomalies: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(anomalies, lambda a: severity_rank(a["severity"]))), F.lit(0))


def top_rules(df: DataFrame, key: list[str], ordered_ids: str, n: int, alphabetical: bool = False) -> DataFrame:
    """``top_rules``: each key's most frequent ids of an array column; ties by first seen or by name."""
    e = df.select(*key, F.posexplode(ordered_ids).alias("pos", "id"))
    c = e.groupBy(*key, "id").agg(F.count("*").alias("c"), F.min("pos").alias("first"))
    tie = F.col("id") if alphabetical else F.col("first")
    c = c.withColumn(
        "rn", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("c"), tie))
    ).where(F.col("rn") <= n)
    return c.groupBy(*key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rn", "id"))), lambda x: x["id"]).alias("top_rules")
    )


def min_window_item(summaries: DataFrame, n: int = 3) -> DataFrame:
    """The short form of windows; a window's few rule ids are counted inside the row."""
    ids = F.filter(F.col("anomalies.rule_id"), lambda r: r.isNotNull())
    times = lambda r: F.size(F.filter(F.col("__ids"), lambda x: x == r))
    d = summaries.withColumn("__ids", ids)
    ranked = F.array_sort(
        F.transform(
            F.array_distinct("__ids"),
            lambda r: F.struct((-times(r)).alias("c"), F.array_position(F.col("__ids"), r).alias("p"), r.alias("id")),
        )
    )
    return d.select(
        "window_id",
        F.col("time.start").alias("start"),
        F.col("time.end").alias("end"),
        "signature",
        max_severity(F.col("anomalies")).alias("max_severity"),
        F.transform(F.slice(ranked, 1, n), lambda x: x["id"]).alias("top_rules"),
        "text_summary",
    )


def active_incidents(summaries: DataFrame, n: int = 3) -> DataFrame:
    """Windows grouped by signature, newest first; ids tie by first window, then place in it.

    One pass over the windows: an id's row carries its windows' times, and a window counts where its first
    id (or none) stands.
    """
    ids = F.posexplode_outer("anomalies.rule_id").alias("pos", "id")
    d = summaries.where(F.coalesce("signature", F.lit("")) != "")
    sev = max_severity(F.col("anomalies")).alias("sev")
    e = d.select("signature", "window_id", F.col("time.start").alias("t0"), F.col("time.end").alias("t1"), sev, ids)
    per_id = e.groupBy("signature", "id").agg(
        F.count("*").alias("c"),
        F.min(F.struct("window_id", "pos")).alias("first"),
        F.min("t0").alias("t0"),
        F.max("t1").alias("t1"),
        F.max("sev").alias("sev"),
        F.count_if(F.coalesce("pos", F.lit(0)) == 0).alias("windows"),
    )
    ranked = F.when(F.col("id").isNotNull(), F.struct((-F.col("c")).alias("c"), "first", "id"))
    out = per_id.groupBy("signature").agg(
        F.min("t0").alias("first_seen"),
        F.max("t1").alias("last_seen"),
        F.sum("windows").alias("count"),
        F.max("sev").alias("max_severity"),
        F.transform(F.slice(F.array_sort(F.collect_list(ranked)), 1, n), lambda x: x["id"]).alias("top_rules"),
    )
    return out.orderBy(F.desc("last_seen"), "signature")


def ring_buffer(summaries: DataFrame, arrival: str, maxlen: int = 500) -> DataFrame:
    """Each unit's newest windows; of equal ids the latest arrival counts."""
    once = last_n(summaries, "window_id", [arrival], 1).drop("rn")
    return last_n(once, "ahu_id", [arrival], maxlen).drop("rn")


def windows_latest(summaries: DataFrame, limit: int | None = None, most: int = KEPT_WINDOWS) -> DataFrame:
    """Each unit's newest windows, newest first, under the names of the window list."""
    n = most if limit is None or limit <= 0 else min(limit, most)
    w = Window.partitionBy("ahu_id").orderBy(F.desc("time.end"), F.desc("window_id"))
    d = summaries.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)
    return d.select(
        "ahu_id",
        "rn",
        "window_id",
        F.col("time.start").alias("start_ts"),
        F.col("time.end").alias("end_ts"),
        max_severity(F.col("anomalies")).alias("severity"),
        F.col("text_summary").alias("diagnosis"),
    )


def window_by_id(summaries: DataFrame, window_id: str) -> DataFrame:
    """The windows of an id: one row at most in a store of windows."""
    return summaries.where(F.col("window_id") == window_id)


def window_detail(summaries: DataFrame) -> DataFrame:
    """Windows as the detail page shows them; rules that passed aren't recorded."""
    failed = F.filter("anomalies", lambda a: a.isNotNull())
    passed = F.filter("anomalies", lambda a: F.lit(False))
    return summaries.select(
        "window_id",
        F.col("time.start").alias("start_ts"),
        F.col("time.end").alias("end_ts"),
        max_severity(F.col("anomalies")).alias("severity"),
        F.nullif("text_summary", F.lit("")).alias("diagnosis"),
        F.lit(None).cast("double").alias("confidence"),
        F.struct("ahu_id", "signature", "text_summary").alias("summary"),
        "features",
        F.struct(failed.alias("failed"), passed.alias("passed")).alias("rules"),
    )


def windows_in_last(summaries: DataFrame, minutes: int, as_of: str) -> DataFrame:
    """Windows that ended within so many minutes (MOST_MINUTES at most) before ``as_of``."""
    since = F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {min(minutes, MOST_MINUTES)} MINUTES")
    return summaries.where(F.col("time.end").cast("timestamp") >= since)


def incident_windows(summaries: DataFrame, signature: str, limit: int = 50) -> DataFrame:
    """Each unit's newest windows of a signature, newest first, in their short form."""
    w = Window.partitionBy("ahu_id").orderBy(F.desc("time.end"), F.desc("window_id"))
    own = summaries.where(F.col("signature") == signature).withColumn("rn", F.row_number().over(w))
    return min_window_item(own.where(F.col("rn") <= min(limit, MOST_ROWS)))


def ticket_view(refs: Column, signatures: Column, evidence: Column, symptom: Column) -> Column:
    """Struct of a ticket's last two window references and first three signatures.

    Without references those of windows among the evidence count, without signatures the one that the
    symptom text names.
    """
    blank = lambda x: x.isNotNull() & (x != "")
    own = F.filter(refs, blank)
    own = F.array_distinct(F.when(F.size(own) > 0, own).otherwise(F.filter(evidence, is_window_evidence)))
    named = F.regexp_extract(F.coalesce(symptom, F.lit("")), "(?i)signature=([a-f0-9]{8,})", 1)
    signed = F.filter(signatures, blank)
    signed = F.when(F.size(signed) > 0, signed).otherwise(F.filter(F.array(named), blank))
    last_two = F.slice(own, F.greatest(F.lit(1), F.size(own) - 1), F.lit(2))
    return F.struct(last_two.alias("window_refs"), F.slice(F.array_distinct(signed), 1, 3).alias("signatures"))


def overview(telemetry: DataFrame, windows: DataFrame, as_of: str, threshold_sec: int = 15) -> DataFrame:
    """Each unit's newest signals beside its newest window."""
    signals = ["sat", "rat", "valve_pos", "fan_speed"]
    values = [pick(telemetry, n).cast("double").alias(n) for n in signals]
    t = telemetry.groupBy("ahu_id").agg(
        F.max("timestamp").alias("last_ts"), F.max_by(F.struct(*values), F.col("timestamp")).alias("v")
    )
    item = F.struct("window_id", "text_summary", max_severity(F.col("anomalies")).alias("severity"))
    w = windows.groupBy("ahu_id").agg(F.max_by(item, F.struct("time.end", "window_id")).alias("w"))
    live = F.coalesce(online(F.col("last_ts"), F.lit(as_of).cast("timestamp"), threshold_sec), F.lit(False))
    return t.join(w, "ahu_id", "full").select(
        "ahu_id",
        live.alias("system_online"),
        iso_z(F.col("last_ts")).alias("last_updated"),
        *[F.col(f"v.{n}").alias(n) for n in signals],
        F.nullif("w.text_summary", F.lit("")).alias("diagnosis"),
        F.lit(None).cast("double").alias("confidence"),
        F.col("w.severity").alias("severity"),
        F.col("w.window_id").alias("active_window_id"),
    )


def units(telemetry: DataFrame, windows: DataFrame) -> DataFrame:
    """Every unit that telemetry or windows know."""
    return telemetry.select("ahu_id").union(windows.select("ahu_id")).distinct()


def health(telemetry: DataFrame, windows: DataFrame) -> DataFrame:
    """One row: newest time and number of telemetry rows, newest end and number of windows, sorted units."""
    t = telemetry.agg(F.max("timestamp").alias("__t"), F.count("*").alias("points_cached_total"))
    w = windows.agg(F.max("time.end").alias("last_window_end"), F.count("*").alias("windows_cached_total"))
    both = units(telemetry, windows).agg(F.array_sort(F.collect_set("ahu_id")).alias("ahus"))
    one = t.join(F.broadcast(w)).join(F.broadcast(both))  # one row each
    return one.select(
        F.lit("ok").alias("status"),
        iso_z(F.col("__t")).alias("last_ts"),
        "points_cached_total",
        "last_window_end",
        "windows_cached_total",
        "ahus",
    )
