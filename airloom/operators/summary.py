"""Window summaries (F8, F11 to F13) and their JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions.scalars import fixed, iso_z, signature, window_id
from .windows import feature_map

# The features that a text shows, with their decimals; the text's form is in ``text_summary``.
HIGHLIGHTS = (("sa_temp_mean", 2), ("sa_temp_mean_minus_sp", 2), ("cc_valve_mean", 1), ("avg_zone_temp_mean", 2))


def text_summary(df: DataFrame) -> Column:
    parts = [
        F.when(F.col(n).isNotNull(), F.concat(F.lit(f"{n}="), fixed(d)(F.col(n))))
        for n, d in HIGHLIGHTS
        if n in df.columns
    ]
    shown = F.nullif(F.concat_ws(", ", *parts), F.lit("")) if parts else F.lit(None)
    rules = F.nullif(F.array_join(F.array_sort(F.col("anomalies.rule_id")), ","), F.lit(""))
    return F.concat(
        F.lit("AHU "),
        F.col("ahu_id"),
        F.lit(" window "),
        iso_z(F.col("start")),
        F.lit("–"),
        iso_z(F.col("end")),
        F.lit(": "),
        F.coalesce(shown, F.lit("no feature highlights")),
        F.lit(". anomalies="),
        F.coalesce(rules, F.lit("none")),
        F.lit(". signature="),
        F.col("signature"),
    )


def summaries(
    windows: DataFrame, cfg: Config, config_sha256: str | None = None, config_paths: tuple[str, ...] = ()
) -> DataFrame:
    """Canonical window events from windows with anomalies; with the configuration's fingerprint and files, if given."""
    w = cfg.windowing
    d = windows.withColumn("signature", signature(F.col("anomalies.rule_id")))
    stats = [
        F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) if c in d.columns else F.lit(0).cast("long").alias(c)
        for c in ("sample_count", "missing_count", "duplicate_count", "late_count")
    ]
    time = F.struct(
        iso_z(F.col("start")).alias("start"),
        iso_z(F.col("end")).alias("end"),
        F.lit(w.kind).alias("window_type"),
        F.lit(w.size_sec).alias("window_size_sec"),
        F.lit(w.step_sec).cast("int").alias("step_sec"),
    )
    out = d.select(
        window_id(F.col("ahu_id"), F.col("start"), F.col("end"), F.lit(w.kind)).alias("window_id"),
        "ahu_id",
        time.alias("time"),
        F.struct(*stats).alias("stats"),
        feature_map(d, cfg).alias("features"),
        "anomalies",
        "signature",
        text_summary(d).alias("text_summary"),
    )
    if not config_sha256:
        return out
    paths = F.array(*map(F.lit, config_paths)) if config_paths else F.array().cast("array<string>")
    source = F.struct(F.lit(config_sha256).alias("sha256"), paths.alias("paths"))
    return out.withColumn("provenance", F.struct(source.alias("config")))


def json_lines(df: DataFrame) -> DataFrame:
    """One column ``value``: rows as JSON with sorted top-level keys and nulls written.

    The evidence of ``anomalies`` is JSON text in a table and an object in a line.
    """
    kind = df.schema["anomalies"].dataType if "anomalies" in df.columns else None
    fields = getattr(getattr(kind, "elementType", None), "names", [])
    if "evidence" in fields and kind.elementType["evidence"].dataType.simpleString() == "string":
        value = lambda a, n: F.try_parse_json(a[n]) if n == "evidence" else a[n]
        df = df.withColumn(
            "anomalies", F.transform("anomalies", lambda a: F.struct(*[value(a, n).alias(n) for n in fields]))
        )
    return df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("value"))
