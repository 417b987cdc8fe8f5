"""Seeded telemetry of scenarios (S21, G1 to G5): one group per scenario, its steps in arrays."""

from __future__ import annotations

from datetime import datetime, timezone

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..config import SIGNALS

# The normal profile and how many random draws a step takes, alone and with each fault.
PROFILE = {
    "setpoint": 14.0,
    "min_oa": 20.0,
    "fan": 60.0,
    "zone": 24.0,
    "zone_tau": 2700.0,
    "temp_sigma": 0.08,
    "damper_sigma": 1.0,
    "valve_sigma": 1.5,
    "fan_sigma": 0.8,
    "zone_start_sigma": 0.3,
}
DRAWS = {None: 9, "cooling_coil_fault": 1, "stuck_damper_fault": 4, "zone_temp_sensor_drift": 1, "normal_operation": 0}


def _epoch(s: str) -> float:
    t = datetime.fromisoformat(s.replace("Z", "+00:00"))
    return (t if t.tzinfo else t.replace(tzinfo=timezone.utc)).timestamp()


def series(scenario: dict) -> pd.DataFrame:
    """All rows of one scenario.

    A generator seeded by the scenario gives one draw for the start and nine a step, more in a fault; all are taken at once
    and dealt to the steps in order.  Only the zone temperature depends on the step before it.
    """
    # All figures from here on, of the profile, its noise and the faults.
    p = PROFILE
    start, end, dt = _epoch(scenario["start_time"]), _epoch(scenario["end_time"]), int(
        scenario["sampling_interval_sec"]
    )
    t = np.arange(start, end, dt)
    n = len(t)
    which = np.full(n, -1)
    episodes = scenario["fault_episodes"]
    for i in range(len(episodes) - 1, -1, -1):
        which[(t >= _epoch(episodes[i]["start_time"])) & (t < _epoch(episodes[i]["end_time"]))] = i
    kinds = [
        e["fault_type"] if not (
            e["fault_type"] == "stuck_damper_fault" and (
                e.get("fault_params") or {}
            ).get("damper", "oa_damper") not in ("oa_damper", "ra_damper")
        ) else "normal_operation"
        for e in episodes
    ]
    kinds = [k if float(e["magnitude"]) > 0 else "normal_operation" for k, e in zip(kinds, episodes)]
    extra = np.array([DRAWS[kinds[i]] if i >= 0 else 0 for i in which])
    first = 1 + np.cumsum(9 + extra) - (9 + extra)
    z = np.random.default_rng(int(scenario["seed"])).standard_normal(1 + int((9 + extra).sum()))
    draw = lambda k, at=slice(None): z[first[at] + k]
    r3 = lambda x: np.round(x, 3)

    minutes = (t % 86_400) / 60
    oa = np.clip(26 + 6 * np.sin(2 * np.pi * minutes / 1440 - np.pi / 2) + p["temp_sigma"] * draw(0), 10, 45)
    alpha, state, zone = 1 - np.exp(-dt / p["zone_tau"]), p["zone"] + p["zone_start_sigma"] * z[0], np.empty(n)
    for i, e in enumerate(p["temp_sigma"] * 0.1 * draw(1)):
        state = (1 - alpha) * state + alpha * p["zone"] + e
        zone[i] = state
    zone = np.clip(zone, 20, 28)
    ra = np.clip(zone + p["temp_sigma"] * draw(2), 18, 30)
    oad = np.clip(p["min_oa"] + p["damper_sigma"] * draw(3), 0, 100)
    rad = np.clip(100 - oad, 0, 100)
    share = oad / np.maximum(1e-9, oad + rad)
    ma = np.clip(
        share * oa + (1 - share) * ra + p["temp_sigma"] * 0.5 * draw(4), np.minimum(oa, ra), np.maximum(oa, ra)
    )
    sp = np.clip(p["setpoint"] + 0.05 * draw(5), 12, 18)
    demand = np.clip((ma - sp) / 10, 0, 1)
    valve = np.clip(15 + 85 * demand + p["valve_sigma"] * draw(6), 0, 100)
    sa = np.clip(ma - (0.15 + 0.8 * valve / 100) * (ma - sp) + p["temp_sigma"] * 0.4 * draw(7), 10, 20)
    fan = np.clip(p["fan"] + 25 * demand + p["fan_sigma"] * draw(8), 0, 100)
    d = {
        "oa_temp": oa,
        "ra_temp": ra,
        "ma_temp": ma,
        "sa_temp": sa,
        "sa_temp_sp": sp,
        "avg_zone_temp": zone,
        "cc_valve": valve,
        "oa_damper": oad,
        "ra_damper": rad,
        "sa_fan_speed": fan,
    }
    d = {k: r3(v) for k, v in d.items()}

    for i, (e, kind) in enumerate(zip(episodes, kinds)):
        at = np.flatnonzero(which == i)
        if not len(at) or kind == "normal_operation":
            continue
        q = e.get("fault_params") or {}
        a, b = _epoch(e["start_time"]), _epoch(e["end_time"])
        ramp = float(q.get("ramp_minutes", 0) or 0) * 60
        mag = min(1.0, max(0.0, float(e["magnitude"]))) * (np.clip((t[at] - a) / ramp, 0, 1) if ramp > 0 else 1.0)
        if kind == "cooling_coil_fault":
            eff = min(1.0, max(0.0, float(q.get("cooling_effectiveness", 0.3))))
            gap = d["ma_temp"][at] - d["sa_temp_sp"][at]
            done = np.where(
                np.abs(gap) > 1e-9, np.clip((d["ma_temp"][at] - d["sa_temp"][at]) / np.where(gap == 0, 1, gap), 0, 1), 0
            )
            done = np.clip(done * (1 - mag) + done * eff * mag, 0, 1)
            d["cc_valve"][at] = r3(np.clip(d["cc_valve"][at] + (100 - d["cc_valve"][at]) * 0.75 * mag, 0, 100))
            d["sa_temp"][at] = r3(np.clip(d["ma_temp"][at] - done * gap + 0.08 * draw(9, at), 10, 20))
            d["avg_zone_temp"][at] = r3(
                np.clip(d["avg_zone_temp"][at] + 0.8 * mag * (t[at] - a) / max(1.0, b - a), 20, 28)
            )
        elif kind == "stuck_damper_fault":
            stuck, own = min(100.0, max(0.0, float(q.get("stuck_value", 100)))), q.get("damper", "oa_damper")
            moved = np.clip(d[own][at] + (stuck - d[own][at]) * mag, 0, 100)
            oad, rad = (
                moved, np.clip(100 - moved, 0, 100)
            ) if own == "oa_damper" else (np.clip(100 - moved, 0, 100), moved)
            ma = oad / 100 * d["oa_temp"][at] + (1 - oad / 100) * d["ra_temp"][at] + 0.12 * draw(9, at)
            demand = np.clip((ma - d["sa_temp_sp"][at]) / 10, 0, 1)
            valve = np.clip(15 + 85 * demand + 1.2 * draw(10, at), 0, 100)
            sa = np.clip(ma - (0.15 + 0.8 * valve / 100) * (ma - d["sa_temp_sp"][at]) + 0.1 * draw(11, at), 10, 20)
            fan = np.clip(d["sa_fan_speed"][at] + 15 * demand * mag + 0.7 * draw(12, at), 0, 100)
            for k, v in (
                ("oa_damper", oad),
                ("ra_damper", rad),
                ("ma_temp", ma),
                ("cc_valve", valve),
                ("sa_temp", sa),
                ("sa_fan_speed", fan),
            ):
                d[k][at] = r3(v)
        else:
            drift = float(q.get("drift_c_per_hour", 0.5)) * np.maximum(0, t[at] - a) / 3600 * mag + 0.02 * draw(9, at)
            d["avg_zone_temp"][at] = r3(np.clip(d["avg_zone_temp"][at] + drift, 20, 28))
    out = pd.DataFrame(d)
    out.insert(0, "ahu_id", str(scenario["ahu_id"]))
    out.insert(0, "timestamp", [datetime.fromtimestamp(x, timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ") for x in t])
    return out


def simulate(spark: SparkSession, scenarios: list[dict]) -> DataFrame:
    """Telemetry of scenarios, each generated in its own group."""
    import json

    schema = "timestamp string, ahu_id string, " + ", ".join(f"{s} double" for s in SIGNALS)
    rows = spark.createDataFrame([(i, json.dumps(s)) for i, s in enumerate(scenarios)], "n int, scenario string")
    return rows.groupBy("n").applyInPandas(lambda pdf: series(json.loads(pdf.scenario[0])), schema)
