"""Fault types, streaks and ticket episodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fault type of each rule.
RULE_FAULT = {
    "SAT_NOT_DROPPING_WHEN_VALVE_HIGH": "COOLING_COIL_FAULT",
    "SAT_TOO_HIGH_WHEN_VALVE_HIGH": "COOLING_COIL_FAULT",
    "OA_DAMPER_STUCK_OR_FLATLINE": "OA_DAMPER_STUCK",
    "RA_DAMPER_STUCK_OR_FLATLINE": "RA_DAMPER_STUCK",
    "ZONE_TEMP_PERSISTENT_TREND": "ZONE_TEMP_SENSOR_DRIFT",
    "ZONE_TEMP_SENSOR_NOISY": "ZONE_TEMP_SENSOR_DRIFT",
}


def rule_fault(rule_id: Column) -> Column:
    r = F.upper(F.trim(rule_id))
    out = F.when(r == "", F.lit(None))
    for k, v in RULE_FAULT.items():
        out = out.when(r == k, v)
    return out.otherwise("UNKNOWN")


def hypothesis_fault(token: Column) -> Column:
    """Fault type from the words of a hypothesis."""
    s = F.regexp_replace(F.lower(F.trim(token)), r"\s+", " ")
    has = lambda *w: [s.contains(x) for x in w]
    either = lambda cs: cs[0] if len(cs) == 1 else cs[0] | either(cs[1:])
    stuck = either(has("damper")) & either(has("stuck", "flat"))
    return (
        F.when(s == "", F.lit(None))
        .when(s.contains("cooling") & either(has("coil", "valve", "sat")), "COOLING_COIL_FAULT")
        .when(either(has("outdoor", "oa")) & stuck, "OA_DAMPER_STUCK")
        .when(either(has("return", "ra")) & stuck, "RA_DAMPER_STUCK")
        .when(
            s.contains("zone") & s.contains("temp") & either(has("drift", "trend", "noise")), "ZONE_TEMP_SENSOR_DRIFT"
        )
        .otherwise("UNKNOWN")
    )


def fault_types(anomalies: Column, ignore_unknown: bool = True) -> Column:
    """A window's sorted fault types from its hypotheses and its rules together."""
    hyp = F.flatten(
        F.transform(anomalies, lambda a: F.coalesce(a["fault_hypotheses"], F.array().cast("array<string>")))
    )
    found = F.array_union(
        F.transform(hyp, hypothesis_fault), F.transform(anomalies, lambda a: rule_fault(a["rule_id"]))
    )
    found = F.array_sort(F.array_distinct(F.filter(found, lambda x: x.isNotNull())))
    if ignore_unknown:
        return F.array_except(found, F.array(F.lit("UNKNOWN")))
    return F.when(F.size(found) == 0, F.array(F.lit("UNKNOWN"))).otherwise(found)


def primary_hypothesis(df: DataFrame, key: str, tokens: str) -> DataFrame:
    """Each key's distinct tokens in order and the most frequent one (ties: first seen)."""
    e = df.select(key, F.posexplode(tokens).alias("pos", "t")).where("t <> ''")
    c = e.groupBy(key, "t").agg(F.count("*").alias("c"), F.min("pos").alias("first"))
    best = F.max_by("t", F.struct("c", (-F.col("first")).alias("p")))
    return c.groupBy(key).agg(
        best.alias("primary"),
        F.transform(F.array_sort(F.collect_list(F.struct("first", "t"))), lambda x: x["t"]).alias("all"),
    )


def presence(windows: DataFrame) -> DataFrame:
    """(ahu_id, fault, i, s): for every fault ever seen on a unit, whether each of its windows from the first sighting on has it.

    ``windows``: ahu_id, i (order), faults."""
    seen = windows.select("ahu_id", "i", F.explode("faults").alias("fault"))
    first = seen.groupBy("ahu_id", "fault").agg(F.min("i").alias("first"))
    rows = windows.join(first, "ahu_id").where("i >= first")
    return rows.select("ahu_id", "fault", "i", F.array_contains("faults", F.col("fault")).alias("s"))


def streaks(present: DataFrame) -> DataFrame:
    """``rl``: length so far of the run of equal ``s``, all by windows over one order of a unit's fault."""
    w = Window.partitionBy("ahu_id", "fault").orderBy("i")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    change = F.when(F.lag("s").over(w).eqNullSafe(F.col("s")), 0).otherwise(1)
    d = present.withColumns({"__c": change, "__n": F.row_number().over(w)})
    begun = F.max(F.when(F.col("__c") == 1, F.col("__n"))).over(so_far)
    d = d.withColumns({"island": F.sum("__c").over(so_far), "rl": F.col("__n") - begun + 1})
    return d.drop("__c", "__n")


def episodes(streaked: DataFrame, n_trigger: int = 2, k_clear: int = 3) -> DataFrame:
    """Ticket episodes: opened at the n-th window seen in a row, resolved at the k-th clear one.

    Two more boolean columns may say more of a window: ``has_ticket`` (an open ticket is there already, so
    the first window seen opens the episode) and ``busy`` (a diagnosis is under way, so resolution waits for
    the first later clear window without one).
    """
    w = Window.partitionBy("ahu_id", "fault").orderBy("i")
    until = w.rowsBetween(Window.unboundedPreceding, 0)
    has = F.coalesce("has_ticket", F.lit(False)) if "has_ticket" in streaked.columns else F.lit(False)
    busy = F.coalesce("busy", F.lit(False)) if "busy" in streaked.columns else F.lit(False)
    opens = F.col("s") & ((F.col("rl") >= n_trigger) | has)
    clears = ~F.col("s") & (F.col("rl") >= k_clear) & ~busy
    d = streaked.withColumn("evt", F.when(opens, "S").when(clears, "C"))
    earlier = F.last("evt", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    d = d.withColumn("pe", F.coalesce(earlier, F.lit("C")))
    turned = lambda to, of: F.coalesce((F.col("evt") == to) & (F.col("pe") == of), F.lit(False))
    d = d.withColumn("opened", turned("S", "C")).withColumn("resolved", turned("C", "S"))
    d = d.withColumn("episode", F.sum(F.col("opened").cast("int")).over(until))
    d = d.withColumn("ce", F.coalesce(F.last("evt", ignorenulls=True).over(until), F.lit("C")))
    d = d.where("episode > 0 AND (ce = 'S' OR resolved)")
    return d.groupBy("ahu_id", "fault", "episode").agg(
        F.min(F.when(F.col("opened"), F.col("i"))).alias("opened_at"),
        F.min(F.when(F.col("resolved"), F.col("i"))).alias("resolved_at"),
        F.count_if(F.col("s") & (F.col("ce") == "S")).alias("occurrence_count"),
    )


def recent_union(windows: DataFrame) -> DataFrame:
    """(ahu_id, fault, i, state): faults of a window and those known but not in it, as ``present`` and ``absent``."""
    return presence(windows).withColumn("state", F.when(F.col("s"), "present").otherwise("absent")).drop("s")


def recent_seen(present: DataFrame) -> DataFrame:
    """The last two windows in which each fault was seen, up to every sighting."""
    w = Window.partitionBy("ahu_id", "fault").orderBy("i")
    return present.where("s").withColumn("recent", F.collect_list("i").over(w.rowsBetween(-1, 0)))
