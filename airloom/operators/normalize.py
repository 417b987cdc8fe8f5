"""Validation and normalisation of raw telemetry and window events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..config import Config
from ..functions.scalars import to_float, to_timestamp


def _text(df: DataFrame, *names: str) -> Column:
    found = [F.nullif(F.trim(F.col(n).cast("string")), F.lit("")) for n in names if n in df.columns]
    return F.coalesce(*found, F.lit(None).cast("string"))


def parse_json(df: DataFrame, value: str = "value") -> DataFrame:
    """JSON objects of a text or binary column as timestamp, ahu_id and a map ``signals``; other values are dropped.

    Signals may be nested under ``signals`` or ``values`` or stand beside the other fields.
    """
    s = F.col(value).cast("string")
    flat = F.from_json(s, "map<string,string>")
    nested = F.from_json(F.coalesce(flat["signals"], flat["values"]), "map<string,string>")
    out = df.select("*", flat.alias("__flat"), nested.alias("__nested")).where("__flat IS NOT NULL")
    own = F.map_filter("__flat", lambda k, _: ~k.isin("timestamp", "ts", "ahu_id", "signals", "values"))
    return out.select(
        F.coalesce(F.nullif(F.trim(F.col("__flat")["timestamp"]), F.lit("")), F.col("__flat")["ts"]).alias("timestamp"),
        F.col("__flat")["ahu_id"].alias("ahu_id"),
        F.coalesce("__nested", own).alias("signals"),
    )


def normalize_events(df: DataFrame, cfg: Config = Config()) -> DataFrame:
    """timestamp, timestamp_text, ahu_id and one double per signal; rows without a time or unit are dropped.

    A blank field falls through to its alias; signals come from the map ``signals`` (or ``values``), else
    from columns; what isn't in the vocabulary is dropped.  Other columns of the input, such as an
    arrival number, are kept if their names start with ``arrival``.
    """
    when = _text(df, cfg.timestamp_field, "timestamp", "ts")
    unit = _text(df, cfg.unit_field, "ahu_id")
    nested = next((n for n in ("signals", "values") if n in df.columns), None)
    value = lambda s: F.coalesce(
        F.col(nested)[s] if nested else F.lit(None), F.col(s).cast("string") if s in df.columns else F.lit(None)
    )
    signals = [to_float(value(s)).alias(s) for s in cfg.signals]
    out = df.select(
        to_timestamp(when).alias("timestamp"),
        when.alias("timestamp_text"),
        unit.alias("ahu_id"),
        *[c for c in df.columns if c.startswith("arrival")],
        *signals,
    )
    if cfg.drop_if_missing_timestamp:
        out = out.where("timestamp IS NOT NULL")
    if cfg.drop_if_missing_unit:
        out = out.where("ahu_id IS NOT NULL")
    return out if cfg.allow_missing_values else out.dropna(subset=list(cfg.signals))


def free_form_values(df: DataFrame) -> DataFrame:
    """The serving side's form: any keys, values coerced, nulls left out."""
    return df.withColumn(
        "values", F.map_filter(F.transform_values("signals", lambda _, v: to_float(v)), lambda _, v: v.isNotNull())
    ).drop("signals")


def with_required(df: DataFrame, *names: str) -> DataFrame:
    """Rows in which the named texts are all there and not blank."""
    for n in names:
        df = df.where(F.trim(F.col(n).cast("string")) != "")
    return df


def normalize_windows(df: DataFrame) -> DataFrame:
    """Window summaries with an id, a unit, a signature and times that can be read; others are dropped."""
    there = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    timed = to_timestamp(F.col("time.start")).isNotNull() & to_timestamp(F.col("time.end")).isNotNull()
    return df.where(there("window_id") & there("signature") & F.col("ahu_id").isNotNull() & timed)


def counted(df: DataFrame, valid: Column, name: str = "intake"):
    """``df`` that counts its rows as they pass: consumed, indexed (those that are ``valid``) and skipped.

    Returns the rows that are valid and the observation, whose ``get`` has the counts after an action; in a
    stream they are in the progress reports under ``name``.
    """
    ok = F.coalesce(valid, F.lit(False))
    counts = [F.count("*").alias("consumed"), F.count_if(ok).alias("indexed"), F.count_if(~ok).alias("skipped")]
    if df.isStreaming:
        return df.observe(name, *counts).where(ok), None
    seen = Observation(name)
    return df.observe(seen, *counts).where(ok), seen
