"""Vocabulary, windowing and rules as plain data, with loaders for YAML files of the same layout."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping
from dataclasses import dataclass, field, fields
from pathlib import Path

# Signals with unit and bounds.
SIGNALS = {
    "oa_temp": ("C", 10.0, 45.0),
    "ra_temp": ("C", 18.0, 30.0),
    "ma_temp": ("C", 10.0, 45.0),
    "sa_temp": ("C", 10.0, 20.0),
    "sa_temp_sp": ("C", 12.0, 18.0),
    "avg_zone_temp": ("C", 20.0, 28.0),
    "cc_valve": ("%", 0.0, 100.0),
    "oa_damper": ("%", 0.0, 100.0),
    "ra_damper": ("%", 0.0, 100.0),
    "sa_fan_speed": ("%", 0.0, 100.0),
}
# Features that combine two others.
CROSS_FEATURES = {
    "sa_temp_mean_minus_sp": "sa_temp_mean - sa_temp_sp_mean",
    "ra_temp_mean_minus_sa": "ra_temp_mean - sa_temp_mean",
}


@dataclass(frozen=True)
class Rule:
    severity: str
    symptom: str
    hypotheses: tuple[str, ...]
    message: str
    params: dict = field(default_factory=dict)
    enabled: bool = True


# Rules in the order of evaluation.
RULES = {
    "SAT_NOT_DROPPING_WHEN_VALVE_HIGH": Rule(
        "medium",
        "Cooling demand high but SAT not decreasing",
        ("cooling_coil_fault",),
        "Cooling demand high but supply air temperature not dropping.",
        {"valve_high_pct": 70.0, "sat_slope_min": 0.0, "sa_temp_mean_minus_sp_min": 1.0, "min_samples": 3},
    ),
    "SAT_TOO_HIGH_WHEN_VALVE_HIGH": Rule(
        "medium",
        "SAT above setpoint while valve high",
        ("cooling_coil_fault",),
        "Supply air temperature above setpoint while cooling demand is high.",
        {"valve_high_pct": 70.0, "sa_temp_mean_minus_sp_high": 1.0},
    ),
    "OA_DAMPER_STUCK_OR_FLATLINE": Rule(
        "low",
        "OA damper variance near zero",
        ("stuck_damper_fault",),
        "oa_damper shows near-zero variance (possible stuck/flatline).",
        {"damper_var_eps": 0.05},
    ),
    "RA_DAMPER_STUCK_OR_FLATLINE": Rule(
        "low",
        "RA damper variance near zero",
        ("stuck_damper_fault",),
        "ra_damper shows near-zero variance (possible stuck/flatline).",
        {"damper_var_eps": 0.05},
    ),
    "ZONE_TEMP_PERSISTENT_TREND": Rule(
        "low",
        "Zone temperature persistent trend",
        ("zone_temp_sensor_drift",),
        "Zone temperature shows sustained upward trend.",
        {"zone_slope_high": 0.005, "zone_delta_min": 0.05, "sa_temp_mean_minus_sp_max": 1.0},
    ),
    "ZONE_TEMP_SENSOR_NOISY": Rule(
        "low",
        "Zone temperature variance unusually high",
        ("zone_temp_sensor_drift",),
        "Zone temperature variance unusually high (possible sensor noise).",
        {"zone_var_high": 0.25},
    ),
    "MISSING_DATA_HIGH": Rule(
        "medium",
        "High missing data ratio",
        ("data_quality",),
        "High missing data ratio in window.",
        {"missing_ratio_high": 0.2},
    ),
    "OUT_OF_RANGE_VALUES": Rule(
        "high",
        "Signals outside configured bounds",
        ("data_quality",),
        "One or more signals exceeded configured bounds.",
        {"use_signal_bounds": True},
    ),
}


@dataclass(frozen=True)
class Windowing:
    size_sec: int = 300
    step_sec: int | None = None
    aligned: bool = True

    @property
    def kind(self) -> str:
        return "sliding" if self.step_sec and self.step_sec != self.size_sec else "tumbling"


@dataclass(frozen=True)
class Config:
    signals: dict = field(default_factory=lambda: dict(SIGNALS))
    cross: dict = field(default_factory=lambda: dict(CROSS_FEATURES))
    rules: dict = field(default_factory=lambda: dict(RULES))
    windowing: Windowing = Windowing()
    reorder_sec: int = 5
    timestamp_field: str = "timestamp"
    unit_field: str = "ahu_id"
    allow_missing_values: bool = True
    drop_if_missing_timestamp: bool = True
    drop_if_missing_unit: bool = True

    def with_params(self, rule: str, **params) -> "Config":
        from dataclasses import replace

        r = self.rules[rule]
        return replace(self, rules=self.rules | {rule: replace(r, params=r.params | params)})


def load_yaml(path: str) -> dict:
    """A YAML mapping; an empty file is an empty one, anything else an error."""
    import yaml

    found = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    if found is None:
        return {}
    if not isinstance(found, dict):
        raise ValueError(f"{path}: a mapping is needed")
    return found


def load(signals: str | None = None, rules: str | None = None, windowing: str | None = None) -> Config:
    """A Config from YAML files; what they leave out keeps its default."""
    out: dict = {}
    if signals:
        y = load_yaml(signals)
        out["signals"] = {k: (m.get("unit"), m.get("min"), m.get("max")) for k, m in (y.get("signals") or {}).items()}
        cross = ((y.get("features") or {}).get("cross_signal")) or []
        out["cross"] = {c["name"]: c["expr"] for c in cross}
        schema = y.get("schema") or {}
        out["timestamp_field"] = schema.get("timestamp_field", "timestamp")
        out["unit_field"] = schema.get("ahu_id_field", "ahu_id")
    if rules:
        known = dict(RULES)
        for k, r in (load_yaml(rules).get("rules") or {}).items():
            base = known.get(k, Rule("low", "", (), ""))
            known[k] = Rule(
                r.get("severity", "low"),
                r.get("symptom", ""),
                tuple(r.get("fault_hypotheses") or ()),
                base.message,
                r.get("params") or {},
                r.get("enabled", True),
            )
        out["rules"] = known
    if windowing:
        y = load_yaml(windowing)
        w, order, missing = (y.get(k) or {} for k in ("windowing", "ordering", "missing_data"))
        step = w.get("step_sec") if w.get("window_type", "tumbling") == "sliding" else None
        if w.get("window_type") == "sliding" and not step:
            raise ValueError(f"{windowing}: sliding windows need step_sec")
        out["windowing"] = Windowing(int(w.get("window_size_sec", 300)), step, bool(w.get("align_to_epoch", True)))
        out["reorder_sec"] = int(order.get("reorder_buffer_sec") or 0)
        out["allow_missing_values"] = bool(missing.get("allow_missing_values", True))
        out["drop_if_missing_timestamp"] = bool(missing.get("drop_event_if_missing_timestamp", True))
        out["drop_if_missing_unit"] = bool(missing.get("drop_event_if_missing_ahu_id", True))
    return Config(**out)


def load_folder(folder: str) -> tuple[Config, str]:
    """The Config in a folder's signals.yaml, windowing.yaml and rules.yaml, and the files' fingerprint."""
    paths = [str(Path(folder) / f"{n}.yaml") for n in ("signals", "windowing", "rules")]
    if missing := [p for p in paths if not Path(p).exists()]:
        raise FileNotFoundError(", ".join(missing))
    return load(signals=paths[0], windowing=paths[1], rules=paths[2]), fingerprint(*paths)


def fingerprint(*paths: str) -> str:
    """SHA-256 over each file's path and bytes, a line end after both, in the order of the paths."""
    h = hashlib.sha256()
    for p in sorted(map(Path, paths), key=Path.as_posix):
        h.update(p.as_posix().encode() + b"\n" + p.read_bytes() + b"\n")
    return h.hexdigest()


def load_scenario(path: str) -> dict:
    """A checked scenario: required keys, times, interval, and episodes inside it that don't overlap."""
    from datetime import datetime

    s = json.loads(Path(path).read_text(encoding="utf-8"))
    need = {
        "run_id",
        "scenario_name",
        "ahu_id",
        "start_time",
        "end_time",
        "sampling_interval_sec",
        "seed",
        "signals",
        "fault_episodes",
    }
    if missing := need - set(s):
        raise ValueError(f"missing keys: {sorted(missing)}")
    at = lambda x: datetime.fromisoformat(x.replace("Z", "+00:00"))
    start, end = at(s["start_time"]), at(s["end_time"])
    if end <= start or int(s["sampling_interval_sec"]) <= 0:
        raise ValueError("empty time range or interval")
    last = None
    for e in sorted(s["fault_episodes"], key=lambda e: at(e["start_time"])):
        a, b = at(e["start_time"]), at(e["end_time"])
        if e["fault_type"] not in FAULT_KINDS:
            raise ValueError(f"unknown fault type {e['fault_type']}")
        if not start <= a < b <= end:
            raise ValueError(f"{e['episode_id']}: outside the scenario or empty")
        if not 0 <= float(e["magnitude"]) <= 1:
            raise ValueError(f"{e['episode_id']}: magnitude outside 0..1")
        if float((e.get("fault_params") or {}).get("ramp_minutes", 0) or 0) < 0:
            raise ValueError(f"{e['episode_id']}: negative ramp")
        if last is not None and a < last:
            raise ValueError(f"{e['episode_id']}: overlaps another")
        last = b
    return s


# Fault kinds that a scenario may have.
FAULT_KINDS = ("cooling_coil_fault", "stuck_damper_fault", "zone_temp_sensor_drift", "normal_operation")


def split_csv(value: str) -> list[str]:
    return [v for part in value.split(",") if (v := part.strip())]


@dataclass(frozen=True)
class Settings:
    """Limits and topics of the serving side; ``from_env`` reads them from environment variables."""

    kafka_bootstrap_servers: str = "localhost:9092"
    kafka_telemetry_topics: tuple[str, ...] = ("ahu.telemetry",)
    kafka_window_topics: tuple[str, ...] = ("window_summaries",)
    kafka_auto_offset_reset: str = "earliest"
    kafka_consumer_group_prefix: str = "dashboard"
    kafka_replay_on_startup: bool = False
    telemetry_retention_mins: int = 30
    windows_maxlen: int = 500
    online_threshold_secs: int = 15
    max_points: int = 2000
    max_mins: int = 120
    max_limit: int = 200
    log_level: str = "INFO"
    cors_origins: tuple[str, ...] = ("*",)

    @classmethod
    def from_env(cls, env: Mapping[str, str]) -> Settings:
        """Each field from the variable of its name in capitals; an empty number or switch is the default."""
        found = {}
        for f in fields(cls):
            raw = env.get(f.name.upper())
            if raw is None or (raw.strip() == "" and not isinstance(f.default, (str, tuple))):
                continue
            if isinstance(f.default, bool):
                found[f.name] = raw.strip().lower() in ("1", "true", "yes", "y", "on")
            elif isinstance(f.default, int):
                found[f.name] = int(raw)
            elif isinstance(f.default, tuple):
                found[f.name] = tuple(split_csv(raw))
            else:
                found[f.name] = raw
        reset = found.get("kafka_auto_offset_reset", "earliest").strip().lower()
        found["kafka_auto_offset_reset"] = reset if reset in ("earliest", "latest") else "earliest"
        found["kafka_consumer_group_prefix"] = found.get("kafka_consumer_group_prefix", "").strip() or "dashboard"
        return cls(**found)

    def consumer_group(self, kind: str, started: int | None = None) -> str:
        """A consumer group's name; a replay's has the time it was started, so it reads from the beginning."""
        suffix = f"-{started}" if self.kafka_replay_on_startup and started is not None else ""
        return f"{self.kafka_consumer_group_prefix}-{kind}{suffix}"
