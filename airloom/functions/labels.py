"""What the dashboard reads out of texts, and the labels it shows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import fixed

# Features that a window's text names, with their labels and units.
FEATURE_LABELS = {
    "sa_temp_mean": ("Supply Air Temperature Mean", "°C"),
    "sa_temp_mean_minus_sp": ("Supply Air Temperature Mean Minus Setpoint", "°C"),
    "cc_valve_mean": ("Cooling Coil Valve Mean", "%"),
    "avg_zone_temp_mean": ("Average Zone Temperature Mean", "°C"),
}
# The same features' labels on a ticket.
SYMPTOM_LABELS = {
    "sa_temp_mean": "SAT mean",
    "sa_temp_mean_minus_sp": "SAT − setpoint",
    "cc_valve_mean": "Cooling coil valve mean (%)",
    "avg_zone_temp_mean": "Avg zone temp mean",
}
NONE = "—"


def _number(text: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(text, rf"(?i)\b{name}=(-?[0-9]+(?:\.[0-9]+)?)", 1), F.lit(""))


def feature_labels(text: Column) -> Column:
    """Map of label to value with two decimals and unit, of the features that a window's text names."""
    two = fixed(2)
    pairs = []
    for name, (label, unit) in FEATURE_LABELS.items():
        value = _number(text, name)
        shown = F.when(value.isNotNull(), F.concat(two(value.cast("double")), F.lit(f" {unit}")))
        pairs += [F.lit(label), shown]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())


def key_symptoms(text: Column) -> Column:
    """Struct of a window text's range, its anomalies and its metrics (label and value as written)."""
    window = F.nullif(F.trim(F.regexp_extract(text, r"(?i)window\s+(\S+?):(?=\s)", 1)), F.lit(""))
    names = F.split(F.regexp_extract(text, r"(?i)anomalies=([^.]*)", 1), ",")
    anomalies = F.filter(F.transform(names, lambda x: F.trim(x)), lambda x: x != "")
    metrics = [F.struct(F.lit(v).alias("label"), _number(text, k).alias("value")) for k, v in SYMPTOM_LABELS.items()]
    found = F.filter(F.array(*metrics), lambda m: m["value"].isNotNull())
    return F.struct(window.alias("window"), anomalies.alias("anomalies"), found.alias("metrics"))


def field(text: Column, key: str) -> Column:
    """What follows ``key`` up to the next field, point or line end; null if there is nothing."""
    found = F.regexp_extract(text, rf"(?s){key}(.*?)(?: signature=| anomalies=|\.|\n|\z)", 1)
    return F.nullif(F.trim(found), F.lit(""))


def duration_label(start: Column, end: Column) -> Column:
    """``n minutes`` below an hour, else hours to one decimal; a dash for no or no positive time."""
    minutes = F.floor((F.unix_micros(end) - F.unix_micros(start)) / 60e6 + 0.5)
    tenths = F.floor(minutes / 6 + 0.5)
    whole = F.floor(tenths / 10).cast("string")
    hours = F.when(tenths % 10 == 0, whole).otherwise(F.concat(whole, F.lit("."), (tenths % 10).cast("string")))
    label = F.when(minutes < 60, F.concat(minutes.cast("string"), F.lit(" minutes")))
    label = label.otherwise(F.concat(hours, F.lit(" hours")))
    return F.when(F.coalesce(minutes, F.lit(0)) > 0, label).otherwise(NONE)


def fault_label(fault: Column) -> Column:
    """``COOLING_COIL_FAULT`` as ``Cooling Coil Fault``."""
    words = F.split(F.lower(F.trim(F.replace(fault, F.lit("_"), F.lit(" ")))), r"\s+")
    title = F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w))))
    return F.when(F.trim(F.coalesce(fault, F.lit(""))) != "", F.array_join(title, " ")).otherwise(NONE)


def unit_label(unit: Column) -> Column:
    """``AHU 3`` for ``3`` or ``ahu3``; other names as they are."""
    s = F.trim(F.coalesce(unit, F.lit("")))
    known = F.when(s.rlike(r"(?i)^ahu\s*\d+"), F.regexp_replace(s, r"(?i)^ahu\s*", "AHU "))
    return F.when(s == "", NONE).otherwise(
        F.coalesce(known, F.when(s.rlike(r"^\d+$"), F.concat(F.lit("AHU "), s)), s)
    )


def percent(confidence: Column) -> Column:
    """A confidence as whole percent within 0 and 100; none is 0."""
    return F.greatest(
        F.lit(0), F.least(F.lit(100), F.floor(F.coalesce(confidence, F.lit(0.0)) * 100 + 0.5))
    ).cast("int")


def root_cause_parts(text: Column) -> Column:
    """Struct of a root cause's statement and its reasoning, which starts with ``Reasoning:``."""
    at = F.position(F.lit("Reasoning:"), text)
    primary = F.when(at > 0, F.substring(text, F.lit(1), at - 1)).otherwise(text)
    reasoning = F.when(at > 0, F.substring(text, at, F.length(text))).otherwise("")
    return F.struct(F.trim(primary).alias("primary"), F.trim(reasoning).alias("reasoning"))
