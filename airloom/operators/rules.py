"""Threshold rules compiled to columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config


def condition(rule: str, cfg: Config, has: set[str]) -> Column:
    """Whether a rule fires on a window's features; null inputs never fire."""
    p = cfg.rules[rule].params
    c = lambda n: F.col(n) if n in has else F.lit(None).cast("double")
    diff = c("sa_temp_mean_minus_sp")
    if rule == "SAT_NOT_DROPPING_WHEN_VALVE_HIGH":
        return (F.col("sample_count") >= p.get("min_samples", 0)) & (
            F.coalesce(diff, F.lit(0.0)) >= p.get("sa_temp_mean_minus_sp_min", 0.0)
        ) & (c("cc_valve_mean") > p["valve_high_pct"]) & (c("sa_temp_slope") >= p["sat_slope_min"])
    if rule == "SAT_TOO_HIGH_WHEN_VALVE_HIGH":
        return (c("cc_valve_mean") > p["valve_high_pct"]) & (diff > p["sa_temp_mean_minus_sp_high"])
    if rule in ("OA_DAMPER_STUCK_OR_FLATLINE", "RA_DAMPER_STUCK_OR_FLATLINE"):
        return c(f"{rule[:2].lower()}_damper_var") < p["damper_var_eps"]
    if rule == "ZONE_TEMP_PERSISTENT_TREND":
        most = p.get("sa_temp_mean_minus_sp_max")
        calm = ~F.coalesce(diff > most, F.lit(False)) if most is not None else F.lit(True)
        return calm & (c("avg_zone_temp_slope") > p["zone_slope_high"]) & (
            F.coalesce(c("avg_zone_temp_delta"), F.lit(0.0)) >= p.get("zone_delta_min", 0.0)
        )
    if rule == "ZONE_TEMP_SENSOR_NOISY":
        return c("avg_zone_temp_var") > p["zone_var_high"]
    if rule == "MISSING_DATA_HIGH":
        return missing_ratio(cfg) > p["missing_ratio_high"]
    if rule == "OUT_OF_RANGE_VALUES":
        if not p.get("use_signal_bounds", True):
            return F.lit(False)
        out = F.lit(False)
        for s, (_, low, high) in cfg.signals.items():
            if low is not None:
                out |= F.coalesce(c(f"{s}_min") < low, F.lit(False))
            if high is not None:
                out |= F.coalesce(c(f"{s}_max") > high, F.lit(False))
        return out
    raise ValueError(f"unknown rule {rule}")


# The features that a rule's evidence shows; 0.0 stands for a missing one after ``=``.
EVIDENCE = {
    "SAT_NOT_DROPPING_WHEN_VALVE_HIGH": ("cc_valve_mean", "sa_temp_slope", "sa_temp_mean_minus_sp=0.0"),
    "SAT_TOO_HIGH_WHEN_VALVE_HIGH": ("cc_valve_mean", "sa_temp_mean_minus_sp", "sa_temp_mean", "sa_temp_sp_mean"),
    "OA_DAMPER_STUCK_OR_FLATLINE": ("oa_damper_var", "oa_damper_mean"),
    "RA_DAMPER_STUCK_OR_FLATLINE": ("ra_damper_var", "ra_damper_mean"),
    "ZONE_TEMP_PERSISTENT_TREND": ("avg_zone_temp_slope", "avg_zone_temp_delta=0.0", "avg_zone_temp_var"),
    "ZONE_TEMP_SENSOR_NOISY": ("avg_zone_temp_var",),
    "MISSING_DATA_HIGH": ("missing_ratio", "missing_count", "sample_count", "num_signals"),
}


def missing_ratio(cfg: Config) -> Column:
    return F.col("missing_count") / F.greatest(F.col("sample_count") * len(cfg.signals), F.lit(1))


def evidence(rule: str, cfg: Config, has: set[str]) -> Column:
    """The figures behind a rule as JSON text: features and thresholds, or the offending features with their bounds.

    Missing figures are written as null, but a missing ``sa_temp_delta`` is left out.
    """
    p = cfg.rules[rule].params
    own = {"missing_ratio": missing_ratio(cfg), "num_signals": F.lit(len(cfg.signals))}
    c = lambda n: own[n] if n in own else F.col(n) if n in has else F.lit(None).cast("double")
    text = lambda *fields: F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    if rule == "OUT_OF_RANGE_VALUES":
        found = []
        for s, (_, low, high) in cfg.signals.items():
            bounds = [F.lit(v).cast("double").alias(n) for n, v in (("min", low), ("max", high))]
            for k, bad in (("min", c(f"{s}_min") < low), ("max", c(f"{s}_max") > high)):
                entry = F.struct(c(f"{s}_{k}").alias("value"), *bounds)
                found.append(F.when(bad, F.struct(F.lit(f"{s}_{k}").alias("key"), entry.alias("value"))))
        return text(F.map_from_entries(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("offenders"))
    shown = []
    for spec in EVIDENCE[rule]:
        name, _, instead = spec.partition("=")
        value = F.coalesce(c(name), F.lit(float(instead))) if instead else c(name)
        shown.append(value.alias(name))
    shown.append(F.struct(*[F.lit(v).alias(k) for k, v in sorted(p.items())]).alias("thresholds"))
    if rule == "SAT_NOT_DROPPING_WHEN_VALVE_HIGH":
        delta = c("sa_temp_delta").alias("sa_temp_delta")
        return F.when(delta.isNull(), text(*shown)).otherwise(text(*shown, delta))
    return text(*shown)


def evidence_values(anomalies: DataFrame, *keep: str) -> DataFrame:
    """(``keep``, rule_id, name, value): every figure of exploded anomalies ``a``, read from their evidence as a VARIANT.

    A figure's own shape decides: an object's members are named ``outer.inner``, at any rule; values that aren't
    numbers are null.
    """
    members = lambda v: v.try_cast("map<string,variant>")
    d = anomalies.select(*keep, "a.rule_id", F.explode(members(F.try_parse_json("a.evidence"))).alias("name", "v"))
    d = d.select(*keep, "rule_id", "name", F.explode_outer(members(F.col("v"))).alias("n2", "v2"), "v")
    d = d.select(*keep, "rule_id", F.concat_ws(".", "name", "n2").alias("name"), F.coalesce("v2", "v").alias("v"))
    d = d.select(*keep, "rule_id", "name", F.explode_outer(members(F.col("v"))).alias("n3", "v3"), "v")
    number = F.try_variant_get(F.coalesce("v3", "v"), "$", "double")
    return d.select(*keep, "rule_id", F.concat_ws(".", "name", "n3").alias("name"), number.alias("value"))


def with_anomalies(windows: DataFrame, cfg: Config) -> DataFrame:
    """``anomalies``: the rules that fired, in order, with severity, message, symptom, hypotheses and evidence."""
    has = set(windows.columns)
    fired = []
    for name, r in cfg.rules.items():
        if r.enabled:
            item = F.struct(
                F.lit(name).alias("rule_id"),
                F.lit(r.severity).alias("severity"),
                F.lit(r.message).alias("message"),
                F.lit(r.symptom).alias("symptom"),
                F.array(*map(F.lit, r.hypotheses)).alias("fault_hypotheses"),
                evidence(name, cfg, has).alias("evidence"),
            )
            fired.append(F.when(condition(name, cfg, has), item))
    return windows.withColumn("anomalies", F.filter(F.array(*fired), lambda a: a.isNotNull()))
