"""Telemetry, window, rule, incident and serving queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config, Windowing
from ..functions import scalars as S
from ..operators import diagnosis, gating, incidents, live, ordering, retrieval, rules, summary, windows
from ..sources.adapter import TELEMETRY_SQL, read, telemetry

SIZE = 21_600
_base = Config()
CFG = Config(
    signals=_base.signals | {"sa_temp": ("C", 10.0, 19.0)}, windowing=Windowing(SIZE)
).with_params("ZONE_TEMP_PERSISTENT_TREND", zone_slope_high=0.0005)
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _num(c: str, digits: int = 6):
    return F.round(F.col(c) + 1e-9, digits).alias(c)  # ties of exact fractions fall the same way everywhere


def _win(spark, sf: str) -> DataFrame:
    return windows.windowed(telemetry(spark, sf), CFG)


def _anom(spark, sf: str) -> DataFrame:
    return rules.with_anomalies(_win(spark, sf), CFG)


def _summ(spark, sf: str) -> DataFrame:
    return summary.summaries(_anom(spark, sf), CFG)


def _start():
    return F.unix_timestamp("start").alias("start_s")


def _rules():
    return F.array_join("anomalies.rule_id", ",").alias("rules")


# --- the same in SQL, one common table expression on top of the other
_W = f"ts_s - ts_s % {SIZE}"
_min = f"(epoch_us(ts) / 1e6 - ({_W})) / 60.0"


def _stats(s: str) -> str:
    v = f"FILTER (WHERE {s} IS NOT NULL)"
    return (
        f"avg({s}) AS {s}_mean, var_pop({s}) AS {s}_var, min({s}) AS {s}_min, max({s}) AS {s}_max, CASE "
        f"WHEN count({s}) >= 2 THEN max_by({s}, ts) {v} - min_by({s}, ts) {v} END AS {s}_delta, "
        f"CASE WHEN count({s}) >= 2 THEN regr_slope({s}, {_min}) END AS {s}_slope"
    )


_missing = " + ".join(f"({s} IS NULL)::INT" for s in CFG.signals)
WIN_SQL = f"""{TELEMETRY_SQL},
win0 AS (SELECT ahu_id, {_W} AS start_s, count(*) AS sample_count, sum({_missing})::BIGINT AS missing_count,
  {', '.join(map(_stats, CFG.signals))} FROM tel GROUP BY 1, 2),
win AS (SELECT *, sa_temp_mean - sa_temp_sp_mean AS sa_temp_mean_minus_sp,
  ra_temp_mean - sa_temp_mean AS ra_temp_mean_minus_sa FROM win0)"""
_p = {k: r.params for k, r in CFG.rules.items()}
_bounds = " OR ".join(
    f"coalesce({s}_min < {low}, false) OR coalesce({s}_max > {high}, false)"
    for s, (_, low, high) in CFG.signals.items()
)
RULE_SQL = {
    "SAT_NOT_DROPPING_WHEN_VALVE_HIGH": "sample_count >= 3 AND coalesce(sa_temp_mean_minus_sp, 0) >= 1.0 AND cc_valve_mean > 70 AND sa_temp_slope >= 0",
    "SAT_TOO_HIGH_WHEN_VALVE_HIGH": "cc_valve_mean > 70 AND sa_temp_mean_minus_sp > 1.0",
    "OA_DAMPER_STUCK_OR_FLATLINE": "oa_damper_var < 0.05",
    "RA_DAMPER_STUCK_OR_FLATLINE": "ra_damper_var < 0.05",
    "ZONE_TEMP_PERSISTENT_TREND": "NOT coalesce(sa_temp_mean_minus_sp > 1.0, false) AND avg_zone_temp_slope > 0.0005 AND coalesce(avg_zone_temp_delta, 0) >= 0.05",
    "ZONE_TEMP_SENSOR_NOISY": "avg_zone_temp_var > 0.25",
    "MISSING_DATA_HIGH": f"missing_count / greatest(sample_count * {len(CFG.signals)}, 1) > 0.2",
    "OUT_OF_RANGE_VALUES": _bounds,
}
_list = ", ".join(f"CASE WHEN {c} THEN '{r}' END" for r, c in RULE_SQL.items())
_iso = lambda s: f"strftime(make_timestamp(({s}) * 1000000), '%Y-%m-%dT%H:%M:%SZ')"
_sev = "CASE r " + " ".join(
    f"WHEN '{k}' THEN {dict(low=1, medium=2, high=3)[r.severity]}" for k, r in CFG.rules.items()
) + " END"
ANOM_SQL = f"""{WIN_SQL},
anom AS (SELECT *, list_filter([{_list}], lambda x: x IS NOT NULL) AS rl FROM win)"""
SUMM_SQL = f"""{ANOM_SQL},
summ AS (SELECT *, ahu_id || '_' || {_iso('start_s')} || '_' || {_iso(f'start_s + {SIZE}')}
  || '_tumbling' AS window_id, {_iso('start_s')} AS t0, {_iso(f'start_s + {SIZE}')} AS t1,
  sha256(array_to_string(list_sort(list_distinct(rl)), '|')) AS signature, coalesce(list_max(list_transform(rl,
  lambda r: {_sev})), 0) AS max_severity FROM anom)"""


def symptoms(spark, sf: str) -> DataFrame:
    return _anom(spark, sf).select(
        "ahu_id", _start(), "sample_count", _rules(), S.signature(F.col("anomalies.rule_id")).alias("signature")
    )


@query(
    f"WITH {TELEMETRY_SQL} SELECT event_id, ahu_id, ts_s, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso, sa_temp, "
    f"cc_valve, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN k + 0.5::DOUBLE WHEN 3 THEN NULL "
    f"ELSE 1.0::DOUBLE END AS coerced FROM tel"
)
def q01_normalize_events(spark, sf):
    raw = F.expr(
        "CASE event_id % 5 WHEN 0 THEN ' NaN ' WHEN 1 THEN 'none' WHEN 2 THEN concat(' ', "
        "CAST(k + 0.5D AS STRING), ' ') WHEN 3 THEN 'x1' ELSE 'true' END"
    )
    t = telemetry(spark, sf)
    return t.select(
        "event_id",
        "ahu_id",
        F.unix_timestamp(S.to_timestamp(S.iso_z(F.col("timestamp")))).alias("ts_s"),
        S.iso_z(F.col("timestamp")).alias("iso"),
        "sa_temp",
        "cc_valve",
        S.to_float(raw).alias("coerced"),
    )


def _with_dups(spark, sf) -> DataFrame:
    t = telemetry(spark, sf).select("event_id", "ahu_id", "timestamp")
    dup = t.where("event_id % 50 = 0").withColumn("seq", F.col("event_id") + 7)
    return t.withColumn("seq", F.col("event_id")).unionByName(dup).withColumn(
        "seq", F.col("seq") * 2 + F.when(F.col("seq") == F.col("event_id"), 0).otherwise(1)
    )


_DUPS = f"{TELEMETRY_SQL}, dups AS (SELECT event_id, ahu_id, ts, ts_s, event_id * 2 AS seq FROM tel UNION ALL SELECT event_id, ahu_id, ts, ts_s, (event_id + 7) * 2 + 1 FROM tel WHERE event_id % 50 = 0)"


@query(
    f"WITH {_DUPS} SELECT event_id, ahu_id, seq FROM (SELECT *, row_number() OVER (PARTITION BY ahu_id, "
    f"ts ORDER BY seq) AS n FROM dups) WHERE n = 1"
)
def q02_dedup_events(spark, sf):
    return ordering.first_arrivals(
        _with_dups(spark, sf), ["ahu_id", "timestamp"], "seq"
    ).select("event_id", "ahu_id", "seq")


@query(
    f"""WITH {TELEMETRY_SQL} SELECT event_id, sha256('{{"ahu_id":"' || ahu_id || '","timestamp":"' || strftime(ts,
    '%Y-%m-%dT%H:%M:%SZ') || '"}}') AS eid FROM tel"""
)
def q03_event_id_sha(spark, sf):
    return telemetry(spark, sf).select(
        "event_id", S.event_id(F.col("ahu_id"), S.iso_z(F.col("timestamp"))).alias("eid")
    )


@query(f"WITH {WIN_SQL} SELECT ahu_id, start_s, sample_count, missing_count FROM win")
def q04_tumbling_counts(spark, sf):
    return _win(spark, sf).select("ahu_id", _start(), "sample_count", "missing_count")


_five = ("sa_temp", "cc_valve", "oa_damper")


@query(
    f"WITH {WIN_SQL} SELECT ahu_id, start_s, " + ", ".join(
        f"round({s}_{k} + 1e-9, 6) AS {s}_{k}" for s in _five for k in ("mean", "var", "min", "max")
    ) + " FROM win"
)
def q05_window_stats(spark, sf):
    return _win(spark, sf).select(
        "ahu_id", _start(), *[_num(f"{s}_{k}") for s in _five for k in ("mean", "var", "min", "max")]
    )


@query(
    f"WITH {WIN_SQL} SELECT ahu_id, start_s, " + ", ".join(
        f"round({s}_delta + 1e-9, 6) AS {s}_delta" for s in _five
    ) + " FROM win"
)
def q06_window_delta(spark, sf):
    return _win(spark, sf).select("ahu_id", _start(), *[_num(f"{s}_delta") for s in _five])


@query(
    f"WITH {WIN_SQL} SELECT ahu_id, start_s, " + ", ".join(
        f"round({s}_slope + 1e-9, 6) AS {s}_slope" for s in _five
    ) + " FROM win"
)
def q07_window_slope(spark, sf):
    return _win(spark, sf).select("ahu_id", _start(), *[_num(f"{s}_slope") for s in _five])


@query(
    f"WITH {WIN_SQL} SELECT ahu_id, start_s, round(sa_temp_mean_minus_sp + 1e-9, 6) AS sa_temp_mean_minus_sp, "
    f"round(ra_temp_mean_minus_sa + 1e-9, 6) AS ra_temp_mean_minus_sa FROM win"
)
def q08_cross_features(spark, sf):
    return _win(spark, sf).select("ahu_id", _start(), _num("sa_temp_mean_minus_sp"), _num("ra_temp_mean_minus_sa"))


@query(
    f"WITH {TELEMETRY_SQL}, w AS (SELECT ahu_id, ts_s - ts_s % 900 AS s, count(*) AS n FROM tel "
    f"GROUP BY 1, 2), g AS (SELECT ahu_id, unnest(generate_series(min(s), max(s), 900)) AS s FROM w "
    f"GROUP BY 1) SELECT g.ahu_id, g.s AS start_s, coalesce(n, 0) AS sample_count FROM g LEFT "
    f"JOIN w USING (ahu_id, s)"
)
def q09_gap_windows(spark, sf):
    w = windows.windowed(telemetry(spark, sf), Config(signals={}, cross={}, rules={}, windowing=Windowing(900)), ())
    return windows.fill_gaps(w, 900).select("ahu_id", _start(), "sample_count")


@query(
    f"WITH {TELEMETRY_SQL}, o AS (SELECT unnest([0, 7200, 14400]) AS back) SELECT ahu_id, "
    f"ts_s - ts_s % 7200 - back AS start_s, count(*) AS sample_count, round(avg(sa_temp) + 1e-9, "
    f"6) AS sa_temp_mean FROM tel CROSS JOIN o GROUP BY 1, 2"
)
def q10_sliding_windows(spark, sf):
    c = Config(signals={"sa_temp": CFG.signals["sa_temp"]}, cross={}, windowing=Windowing(SIZE, 7200))
    return windows.windowed(telemetry(spark, sf), c, ("mean",)).select(
        "ahu_id", _start(), "sample_count", _num("sa_temp_mean")
    )


@query(
    f"WITH {_DUPS}, d AS (SELECT *, row_number() OVER (PARTITION BY ahu_id, ts ORDER BY seq) AS n "
    f"FROM dups) SELECT ahu_id, {_W} AS start_s, count(*) FILTER (WHERE n = 1) AS sample_count, "
    f"count(*) FILTER (WHERE n > 1) AS duplicate_count FROM d GROUP BY 1, 2"
)
def q11_dup_accounting(spark, sf):
    d = _with_dups(spark, sf).withColumn(
        "n", F.row_number().over(Window.partitionBy("ahu_id", "timestamp").orderBy("seq"))
    )
    w = F.unix_timestamp(S.epoch_floor(F.col("timestamp"), SIZE)).alias("start_s")
    return d.groupBy("ahu_id", w).agg(
        F.count_if(F.col("n") == 1).alias("sample_count"), F.count_if(F.col("n") > 1).alias("duplicate_count")
    )


_LATE = f"""{TELEMETRY_SQL},
a AS (SELECT ahu_id AS unit, ts_s, event_id * 2 + CASE WHEN event_id % 17 = 0 THEN 400
  ELSE 0 END AS seq, ts_s::VARCHAR AS key FROM tel
      UNION ALL SELECT ahu_id, ts_s, event_id * 2 + 31, ts_s::VARCHAR FROM tel WHERE event_id % 50 = 0),
d AS (SELECT *, row_number() OVER (PARTITION BY unit, key ORDER BY seq) > 1 AS dup FROM a),
m AS (SELECT *, max(CASE WHEN NOT dup THEN ts_s END) OVER (PARTITION BY unit
  ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS mx FROM d),
u AS (SELECT unit, mx AS v, seq AS ms, NULL::BIGINT AS qs FROM m UNION ALL SELECT unit, ts_s + 3600, NULL, seq FROM m
  WHERE NOT dup),
z AS (SELECT unit, qs, min(ms) OVER (PARTITION BY unit ORDER BY v DESC RANGE BETWEEN UNBOUNDED PRECEDING
  AND CURRENT ROW) AS fs FROM u),
r AS (SELECT m.*, CASE WHEN dup THEN seq ELSE greatest(seq, coalesce(fs, 1000000000000000000)) END AS rel FROM m LEFT
  JOIN z ON z.unit = m.unit AND z.qs = m.seq),
p AS (SELECT *, max({_W}) OVER (PARTITION BY unit ORDER BY rel, ts_s,
  seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pf FROM r),
q AS (SELECT *, coalesce(ts_s < pf, false) AS late, CASE WHEN ts_s < pf THEN pf ELSE {_W} END AS w FROM p)"""


@query(
    f"WITH {_LATE} SELECT unit, w AS window_s, count(*) FILTER (WHERE NOT dup AND NOT late) AS sample_count, "
    f"count(*) FILTER (WHERE dup AND NOT late) AS duplicate_count, count(*) FILTER (WHERE late) AS late_count "
    f"FROM q GROUP BY 1, 2"
)
def q12_late_accounting(spark, sf):
    t = telemetry(spark, sf).select(
        F.col("ahu_id").alias("unit"), F.unix_timestamp("timestamp").alias("ts_s"), "event_id"
    )
    a = t.select(
        "unit",
        "ts_s",
        F.expr("event_id * 2 + CASE WHEN event_id % 17 = 0 THEN 400 ELSE 0 END AS seq"),
        F.col("ts_s").cast("string").alias("key"),
    )
    b = t.where("event_id % 50 = 0").select(
        "unit", "ts_s", F.expr("event_id * 2 + 31 AS seq"), F.col("ts_s").cast("string").alias("key")
    )
    return ordering.window_accounts(ordering.account(a.unionByName(b), SIZE, 3600))


def _rule_query(name: str, *ids: str):
    def f(spark, sf):
        w = _win(spark, sf)
        return w.select(
            "ahu_id",
            _start(),
            *[F.coalesce(rules.condition(r, CFG, set(w.columns)), F.lit(False)).alias(r.lower()) for r in ids],
        )

    f.__name__ = name
    query(
        f"WITH {WIN_SQL} SELECT ahu_id, start_s, " + ", ".join(
            f"coalesce({RULE_SQL[r]}, false) AS {r.lower()}" for r in ids
        ) + " FROM win"
    )(f)


_names = list(RULE_SQL)
for _q, _i in (("q13_rules_cooling", 0), ("q14_rules_damper", 2), ("q15_rules_zone", 4), ("q16_rules_quality", 6)):
    _rule_query(_q, *_names[_i : _i + 2])


@query(f"WITH {SUMM_SQL} SELECT ahu_id, start_s, signature, array_to_string(rl, ',') AS rules FROM summ")
def q17_signature(spark, sf):
    return _anom(spark, sf).select(
        "ahu_id", _start(), S.signature(F.col("anomalies.rule_id")).alias("signature"), _rules()
    )


_hl = ", ".join(f"'{n}=' || printf('%.{d}f', {n})" for n, d in summary.HIGHLIGHTS)


@query(f"""WITH {SUMM_SQL} SELECT window_id, 'AHU ' || ahu_id || ' window ' || t0 || '–' || t1 || ': '
  || coalesce(nullif(concat_ws(', ', {_hl}), ''), 'no feature highlights') || '. anomalies='
  || coalesce(nullif(array_to_string(list_sort(rl), ','), ''), 'none') || '. signature=' || signature AS text_summary
  FROM summ""")
def q18_window_summary_text(spark, sf):
    return _summ(spark, sf).select("window_id", "text_summary")


_symptom = "CASE r " + " ".join(f"WHEN '{k}' THEN '{r.symptom}'" for k, r in CFG.rules.items()) + " END"
_hyp = "CASE r " + " ".join(f"WHEN '{k}' THEN '{r.hypotheses[0]}'" for k, r in CFG.rules.items()) + " END"


@query(
    f"WITH {SUMM_SQL}, x AS (SELECT window_id, unnest(rl) AS r FROM summ) SELECT window_id, r AS rule_id, "
    f"{_symptom} AS symptom, {_hyp} AS hypothesis FROM x"
)
def q19_rule_metadata(spark, sf):
    return _summ(spark, sf).select("window_id", F.explode("anomalies").alias("a")).select(
        "window_id", "a.rule_id", "a.symptom", F.col("a.fault_hypotheses")[0].alias("hypothesis")
    )


_EPISODES = (
    ("E1", "2024-01-03 00:00:00", "2024-01-05 12:00:00", 0.7, 300.0),
    ("E2", "2024-01-10 06:00:00", "2024-01-12 00:00:00", 1.0, 0.0),
    ("E3", "2024-01-20 00:00:00", "2024-01-21 00:00:00", 0.3, 60.0),
)
_EP_SQL = "ep AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{i}', TIMESTAMP '{a}', TIMESTAMP '{b}', {m}::DOUBLE, {r}::DOUBLE)" for i, a, b, m, r in _EPISODES
) + ") AS t(episode_id, episode_start, episode_end, magnitude, ramp_minutes))"


def _episodes(spark) -> DataFrame:
    d = spark.createDataFrame(
        list(_EPISODES),
        "episode_id string, episode_start string, episode_end string, magnitude double, ramp_minutes double",
    )
    return d.withColumns({c: F.col(c).cast("timestamp") for c in ("episode_start", "episode_end")})


@query(
    f"WITH {TELEMETRY_SQL}, {_EP_SQL} SELECT event_id, episode_id FROM tel LEFT "
    f"JOIN ep ON ts >= episode_start AND ts < episode_end"
)
def q20_episode_active(spark, sf):
    return gating.active_episode(telemetry(spark, sf), _episodes(spark)).select("event_id", "episode_id")


_OFFSETS = [(100_000, 300_000), (900_000, 1_200_000)]


@query(
    f"WITH {SUMM_SQL}, b AS (SELECT ahu_id, min(ts_s) AS base FROM tel GROUP BY 1) SELECT window_id, CASE WHEN " + " OR ".join(f"(start_s - base >= {a} AND start_s - base < {b})" for a, b in _OFFSETS) + " THEN array_to_string(rl, ',') ELSE '' END AS rules FROM summ JOIN b USING (ahu_id)"
)
def q21_scenario_gating(spark, sf):
    base = telemetry(spark, sf).groupBy("ahu_id").agg(F.min("timestamp").alias("base_ts"))
    g = gating.gate(_anom(spark, sf), _OFFSETS, base)
    return g.select(
        S.window_id(F.col("ahu_id"), F.col("start"), F.col("end"), F.lit("tumbling")).alias("window_id"), _rules()
    )


@query(
    f"WITH {TELEMETRY_SQL}, {_EP_SQL} SELECT event_id, round(CASE "
    f"WHEN ramp_minutes > 0 THEN magnitude * greatest(0.0::DOUBLE, least(1.0::DOUBLE, "
    f"(epoch_us(ts) - epoch_us(episode_start)) / 1e6 / (ramp_minutes * 60))) ELSE magnitude END, 6) AS m "
    f"FROM tel JOIN ep ON ts >= episode_start AND ts < episode_end"
)
def q22_effective_magnitude(spark, sf):
    e = gating.active_episode(telemetry(spark, sf), _episodes(spark)).where("episode_id IS NOT NULL")
    return e.select(
        "event_id",
        F.round(
            gating.effective_magnitude(
                F.col("magnitude"),
                F.col("ramp_minutes"),
                (F.unix_micros("timestamp") - F.unix_micros("episode_start")) / 1e6,
            ),
            6,
        ).alias("m"),
    )


_SPAN = "o_orderkey % 400"


@query(
    f"WITH e AS (SELECT (o_custkey % 97)::VARCHAR AS scenario, o_orderkey::VARCHAR AS episode_id, "
    f"datediff('day', DATE '1990-01-01', o_orderdate::DATE) AS a, datediff('day', DATE '1990-01-01', "
    f"o_orderdate::DATE) "
    f"+ {_SPAN} AS b FROM orders) SELECT scenario, episode_id, coalesce(a < lag(b) OVER (PARTITION BY scenario "
    f'ORDER BY a, episode_id), false) AS "overlaps" FROM e'
)
def q23_episode_overlap(spark, sf):
    """Orders as episodes of so many days, in scenarios by customer."""
    o = read(spark, sf, "orders")
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1990-01-01").cast("date"))
    d = o.select(
        (F.col("o_custkey") % 97).cast("string").alias("scenario"),
        F.col("o_orderkey").cast("string").alias("episode_id"),
        day.alias("episode_start"),
        (day + F.expr(_SPAN)).alias("episode_end"),
    )
    return gating.overlaps(d).select("scenario", "episode_id", "overlaps")


@query(
    f"WITH {TELEMETRY_SQL}, l AS (SELECT ahu_id, max(ts_s) AS ts_s, max_by(event_id, ts) AS event_id, "
    f"max_by(cc_valve, ts) AS cc_valve FROM tel GROUP BY 1) SELECT *, (SELECT max(ts_s) "
    f"FROM tel) - ts_s <= 3600 AS online FROM l"
)
def q24_latest_per_unit(spark, sf):
    t = telemetry(spark, sf)
    newest = t.agg(F.max("timestamp").alias("as_of"))
    d = live.latest(t, "ahu_id", "timestamp", ["event_id", "cc_valve"]).join(F.broadcast(newest))
    return d.select(
        "ahu_id",
        F.unix_timestamp("timestamp").alias("ts_s"),
        "event_id",
        "cc_valve",
        live.online(F.col("timestamp"), F.col("as_of"), 3600).alias("online"),
    )


@query(
    f"WITH {TELEMETRY_SQL} SELECT ahu_id, event_id, rn::INT AS rn "
    f"FROM (SELECT *, row_number() OVER (PARTITION BY ahu_id ORDER BY ts DESC, event_id DESC) AS rn FROM tel) "
    f"WHERE rn <= 5"
)
def q25_last_n(spark, sf):
    return live.last_n(telemetry(spark, sf), "ahu_id", ["timestamp", "event_id"], 5).select("ahu_id", "event_id", "rn")


@query(
    f"WITH {TELEMETRY_SQL}, d AS (SELECT *, count(*) OVER (PARTITION BY ahu_id) AS n, "
    f"row_number() OVER (PARTITION BY ahu_id ORDER BY ts, event_id) AS i FROM tel "
    f"WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20') SELECT ahu_id, event_id, sa_temp "
    f"FROM d WHERE (i - 1) % (CASE WHEN n <= 100 THEN 1 ELSE ceil(n / 100.0)::BIGINT END) = 0 OR i = n"
)
def q26_range_downsample(spark, sf):
    t = live.in_range(telemetry(spark, sf), "timestamp", "2024-01-05", "2024-01-20")
    return live.downsample(t, "ahu_id", ["timestamp", "event_id"], 100).select("ahu_id", "event_id", "sa_temp")


@query(
    f"WITH {TELEMETRY_SQL} SELECT ahu_id, event_id FROM (SELECT *, max(ts) OVER (PARTITION BY ahu_id) AS m "
    f"FROM tel) WHERE ts >= m - INTERVAL 1440 MINUTES"
)
def q27_retention(spark, sf):
    return live.retain(telemetry(spark, sf), "ahu_id", "timestamp", 1440).select("ahu_id", "event_id")


@query(
    f"WITH {SUMM_SQL} SELECT window_id, t0 AS start, t1 AS \"end\", signature, max_severity, "
    f"array_to_string(rl[1:3], ',') AS top_rules FROM summ"
)
def q28_min_window_item(spark, sf):
    return live.min_window_item(_summ(spark, sf)).drop("text_summary").withColumn(
        "top_rules", F.array_join("top_rules", ",")
    )


@query(
    f"WITH {SUMM_SQL} SELECT signature, min(t0) AS first_seen, max(t1) AS last_seen, count(*) AS count, "
    f"max(max_severity) AS max_severity, array_to_string(min(rl)[1:3], ',') AS top_rules FROM summ GROUP BY 1"
)
def q29_active_incidents(spark, sf):
    return live.active_incidents(_summ(spark, sf)).withColumn("top_rules", F.array_join("top_rules", ","))


@query(f"WITH {SUMM_SQL} SELECT signature, window_id, t0 AS start, t1 AS \"end\" FROM summ WHERE max_severity >= 2")
def q30_signature_windows(spark, sf):
    s = _summ(spark, sf).where(live.max_severity(F.col("anomalies")) >= 2)
    return s.select("signature", "window_id", F.col("time.start").alias("start"), F.col("time.end").alias("end"))


_fault = "CASE r " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in incidents.RULE_FAULT.items()) + " END"
_FAULTS = f"{SUMM_SQL}, fl AS (SELECT *, list_sort(list_distinct(list_filter(list_transform(rl, lambda r: {_fault}), lambda x: x IS NOT NULL))) AS faults, dense_rank() OVER (PARTITION BY ahu_id ORDER BY start_s) AS i FROM summ)"


@query(f"WITH {_FAULTS} SELECT window_id, array_to_string(faults, ',') AS faults FROM fl")
def q31_fault_types(spark, sf):
    return _summ(spark, sf).select(
        "window_id", F.array_join(incidents.fault_types(F.col("anomalies")), ",").alias("faults")
    )


def _present(spark, sf) -> DataFrame:
    s = _summ(spark, sf).select(
        "ahu_id",
        incidents.fault_types(F.col("anomalies")).alias("faults"),
        F.row_number().over(Window.partitionBy("ahu_id").orderBy("time.start")).alias("i"),
    )
    return incidents.presence(s)


_STREAK = f"""{_FAULTS}, f1 AS (SELECT ahu_id, f AS fault, min(i) AS first FROM (SELECT ahu_id, i, unnest(faults) AS f
  FROM fl) GROUP BY 1, 2),
pr AS (SELECT fl.ahu_id, f1.fault, fl.i, list_contains(faults, f1.fault) AS s FROM fl
  JOIN f1 ON fl.ahu_id = f1.ahu_id AND fl.i >= f1.first),
c AS (SELECT *, CASE WHEN lag(s) OVER o IS DISTINCT FROM s THEN 1 ELSE 0 END AS ch
  FROM pr WINDOW o AS (PARTITION BY ahu_id, fault ORDER BY i)),
isl AS (SELECT *, sum(ch) OVER (PARTITION BY ahu_id, fault ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING
  AND CURRENT ROW) AS island FROM c),
st AS (SELECT *, row_number() OVER (PARTITION BY ahu_id, fault, island ORDER BY i) AS rl2 FROM isl)"""


@query(f"WITH {_STREAK} SELECT ahu_id, fault, i, s, rl2 AS rl FROM st")
def q32_streaks(spark, sf):
    return incidents.streaks(_present(spark, sf)).select(
        "ahu_id", "fault", F.col("i").cast("long"), "s", F.col("rl").cast("long").alias("rl")
    )


@query(f"""WITH {_STREAK}, v AS (SELECT *, CASE WHEN s AND rl2 = 2 THEN 'S' WHEN NOT s AND rl2 = 3 THEN 'C' END AS evt
  FROM st),
w AS (SELECT *, coalesce(last_value(evt IGNORE NULLS) OVER (PARTITION BY ahu_id,
  fault ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'C') AS pe,
  coalesce(last_value(evt IGNORE NULLS) OVER (PARTITION BY ahu_id,
  fault ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'C') AS ce FROM v),
x AS (SELECT *, coalesce(evt = 'S' AND pe = 'C', false) AS opened, coalesce(evt = 'C' AND pe = 'S', false) AS resolved
  FROM w),
y AS (SELECT *, sum(opened::INT) OVER (PARTITION BY ahu_id, fault ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING
  AND CURRENT ROW) AS episode FROM x)
SELECT ahu_id, fault, episode::BIGINT AS episode, min(i) FILTER (WHERE opened) AS opened_at,
  min(i) FILTER (WHERE resolved) AS resolved_at, count(*) FILTER (WHERE s AND ce = 'S') AS occurrence_count FROM y
  WHERE episode > 0 GROUP BY 1, 2, 3""")
def q33_ticket_episodes(spark, sf):
    e = incidents.episodes(incidents.streaks(_present(spark, sf)))
    return e.select(
        "ahu_id",
        "fault",
        "episode",
        F.col("opened_at").cast("long"),
        F.col("resolved_at").cast("long"),
        "occurrence_count",
    )


@query(
    f"WITH {_STREAK} SELECT ahu_id, fault, i, concat_ws(',', lag(i) OVER (PARTITION BY ahu_id, "
    f"fault ORDER BY i), i) AS recent FROM pr WHERE s"
)
def q34_recent_windows(spark, sf):
    return incidents.recent_seen(_present(spark, sf)).select(
        "ahu_id",
        "fault",
        F.col("i").cast("long"),
        F.array_join(F.col("recent").cast("array<string>"), ",").alias("recent"),
    )


@query(
    f"WITH {SUMM_SQL}, {TELEMETRY_SQL.replace('tel AS', 'tel2 AS', 1)} SELECT DISTINCT ahu_id "
    f"FROM (SELECT ahu_id FROM tel2 UNION SELECT ahu_id FROM summ)"
)
def q40_unit_union(spark, sf):
    return live.units(telemetry(spark, sf), _summ(spark, sf))


@query(
    f"WITH {SUMM_SQL}, x AS (SELECT ahu_id, unnest(rl) AS id FROM summ), c AS (SELECT ahu_id, id, count(*) AS c "
    f"FROM x GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY ahu_id ORDER BY c DESC, id) AS rn "
    f"FROM c) SELECT ahu_id, string_agg(id, ',' ORDER BY rn) AS top_rules FROM r WHERE rn <= 5 GROUP BY 1"
)
def q41_top_rules(spark, sf):
    s = _summ(spark, sf).select("ahu_id", F.col("anomalies.rule_id").alias("ids"))
    return live.top_rules(s, ["ahu_id"], "ids", 5, alphabetical=True).withColumn(
        "top_rules", F.array_join("top_rules", ",")
    )


@query(
    f"WITH {SUMM_SQL}, h AS (SELECT window_id, unnest(list_transform(rl, lambda r: {_hyp})) AS t, "
    f"unnest(range(len(rl))) AS p FROM summ), c AS (SELECT window_id, t, count(*) AS c, min(p) AS f FROM h "
    f"GROUP BY 1, 2) SELECT window_id, first(t ORDER BY c DESC, f) AS \"primary\", string_agg(t, "
    f"',' ORDER BY f) AS \"all\" FROM c GROUP BY 1"
)
def q42_primary_hypothesis(spark, sf):
    s = _summ(spark, sf).select("window_id", F.flatten("anomalies.fault_hypotheses").alias("tokens"))
    return incidents.primary_hypothesis(s, "window_id", "tokens").select(
        "window_id", "primary", F.array_join("all", ",").alias("all")
    )


_TEXT_SQL = f"""'AHU ' || ahu_id || ' window ' || t0 || '–' || t1 || ': ' || coalesce(nullif(concat_ws(', ', {_hl}),
  ''), 'no feature highlights')
  || '. anomalies=' || coalesce(nullif(array_to_string(list_sort(rl), ','), ''),
  'none') || '. signature=' || signature"""
_features = sorted([f"{s}_{k}" for s in CFG.signals for k in windows.STATS] + list(CFG.cross))
_pairs = ", ".join(f"CASE WHEN {n} IS NOT NULL THEN {{'k': '{n}', 'v': round({n} + 1e-9, 6)}} END" for n in _features)
_msg = "CASE r " + " ".join(f"WHEN '{k}' THEN '{r.message}'" for k, r in CFG.rules.items()) + " END"
_HIST = f"""{SUMM_SQL}, t AS (SELECT *, {_TEXT_SQL} AS ts, list_filter([{_pairs}], lambda x: x IS NOT NULL)[1:8] AS fs
  FROM summ),
hy AS (SELECT window_id, unnest(list_transform(rl, lambda r: {_hyp})) AS h, unnest(range(len(rl))) AS p FROM summ),
hc AS (SELECT window_id, h, count(*) AS c, min(p) AS f FROM hy GROUP BY 1, 2),
hp AS (SELECT window_id, first(h ORDER BY c DESC, f) AS prim, string_agg(h, ', ' ORDER BY f) AS al FROM hc
  GROUP BY 1)"""


@query(
    f"""WITH {_HIST} SELECT t.window_id AS id, 'WINDOW: ahu=' || ahu_id || ' window_id=' || t.window_id
    || ' signature=' || signature
  || ' start=' || t0 || ' end=' || t1 || coalesce(chr(10) || 'PRIMARY_HYPOTHESIS: ' || prim || chr(10)
  || 'HYPOTHESES: ' || al || chr(10)
  || 'INCIDENT_KEY: ' || ahu_id || '|' || prim, '') || chr(10) || 'SUMMARY: ' || CASE
  WHEN length(ts) > 300 THEN ts[1:297] || '...' ELSE ts END
  || chr(10) || 'ANOMALIES: ' || coalesce(nullif(array_to_string(list_transform(rl[1:5],
  lambda r: r || ' msg=' || {_msg}), ' | '), ''), 'none')
  || CASE WHEN len(fs) > 0 THEN chr(10) || 'FEATURES: ' || array_to_string(list_transform(fs,
  lambda x: x.k || '=' || printf('%.4g', x.v)), ', ') ELSE '' END
  || chr(10) || 'STATS: sample_count=' || sample_count || ', missing_count=' || missing_count
  || ', late_count=0, duplicate_count=0'
  || chr(10) || 'PROVENANCE: sha256=c0ffee' AS text,
  start_s::VARCHAR AS start_ts, (start_s + {SIZE})::VARCHAR AS end_ts, replace(al, ', ', ',') AS hypotheses,
  ahu_id || '|' || prim AS incident_key,
  nullif(array_to_string(rl, ','), '') AS rule_ids, nullif(array_to_string(list_transform(fs, lambda x: x.k), ','),
  '') AS feature_keys,
  CAST(13 + CASE WHEN prim IS NULL THEN 0 ELSE 3 END + CASE WHEN len(rl) > 0 THEN 1 ELSE 0 END + CASE
  WHEN len(fs) > 0 THEN 1 ELSE 0 END AS INT) AS n
  FROM t LEFT JOIN hp ON hp.window_id = t.window_id"""
)
def q43_history_doc(spark, sf):
    s = summary.summaries(_anom(spark, sf), CFG, "c0ffee")
    d = retrieval.history_documents(
        s.withColumn("features", F.transform_values("features", lambda _, v: S.rounded(v + 1e-9, 6)))
    )
    m = F.col("metadata")
    keys = {
        "hypotheses": "fault_hypotheses",
        **{k: k for k in ("start_ts", "end_ts", "incident_key", "rule_ids", "feature_keys")},
    }
    return d.select("id", "text", *[m[v].alias(k) for k, v in keys.items()], F.size("metadata").alias("n"))


def _by_fault(place: int, other) -> str:
    """The SQL value of a fault's entry."""
    return "CASE fault " + " ".join(
        f"WHEN '{r[0]}' THEN {other(r[place])}" for r in diagnosis.LOOKUP[:-1]
    ) + f" ELSE {other(diagnosis.LOOKUP[-1][place])} END"


_quoted = lambda s: "'" + s.replace("'", "''") + "'"
_joined = lambda xs: _quoted("; ".join(xs))
_number = lambda x: f"{x}::DOUBLE"


@query(
    f"""WITH {_FAULTS}, x AS (SELECT window_id, unnest(faults) AS fault, missing_count = 0 AS covered FROM fl),
y AS (SELECT *, ({_by_fault(3, _number)} < 0.85 OR NOT covered) AS again FROM x)
SELECT window_id, fault, {_by_fault(1, _quoted)} AS title, {_by_fault(2, _quoted)} AS root_cause, CASE
  WHEN again THEN {_by_fault(4, _number)} ELSE {_by_fault(3, _number)} END AS confidence,
  {_by_fault(5, _joined)} AS actions, {_by_fault(6, _joined)} AS evidence, CASE WHEN again THEN 2
  ELSE 1 END AS stage, CASE WHEN again THEN 2 ELSE 1 END AS reasoner_calls FROM y"""
)
def q53_mock_diagnosis(spark, sf):
    """Both stages; a window without missing values counts as covered."""
    s = _summ(spark, sf).select(
        "window_id",
        incidents.fault_types(F.col("anomalies")).alias("faults"),
        (F.col("stats.missing_count") == 0).alias("coverage_ok"),
    )
    d = diagnosis.two_stages(s.select("window_id", F.explode("faults").alias("fault"), "coverage_ok"))
    lists = [
        F.array_join("recommended_actions", "; ").alias("actions"), F.array_join("evidence_ids", "; ").alias("evidence")
    ]
    return d.select("window_id", "fault", "title", "root_cause", "confidence", *lists, "stage", "reasoner_calls")


@query(
    f"WITH {SUMM_SQL} SELECT window_id, printf('%.2f', cc_valve_mean)::DOUBLE AS valve, "
    f"array_to_string(list_sort(rl), ',') AS rules, signature FROM summ"
)
def q56_ui_extract(spark, sf):
    s = _summ(spark, sf).withColumn(
        "t", F.concat("text_summary", F.lit(" "), F.lit("v="), S.fixed(2)(F.col("features")["cc_valve_mean"]))
    )
    pick = lambda p: F.regexp_extract("t", p, 1)
    return s.select(
        "window_id",
        pick(r"v=([0-9.]+)$").cast("double").alias("valve"),
        F.regexp_replace(pick(r"anomalies=([^.]*)\."), "^none$", "").alias("rules"),
        pick(r"signature=([0-9a-f]{64})").alias("signature"),
    )


@query()
def st_window_summaries(spark, sf):
    """The streaming form over the events table as a file stream, up to the last window that the watermark closes."""
    from ..sources.adapter import TELEMETRY
    from ..staging import new_path
    from ..streaming import telemetry as streaming

    at = new_path(spark, "stream")
    raw = spark.readStream.schema(spark.read.parquet(f"{sf}/events.parquet").schema).parquet(f"{sf}/event[s].parquet")
    raw = raw.withColumn(
        "k", F.get_json_object("props", "$.k").cast("int")
    ).withColumn("ts", F.col("ts").cast("timestamp"))
    events = raw.selectExpr(
        "event_id",
        "CAST(user_id % 8 AS STRING) AS ahu_id",
        "ts AS timestamp",
        "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'\") AS timestamp_text",
        *[f"{x} AS {n}" for n, x in TELEMETRY.items()],
    )
    out = streaming.window_summaries(events, CFG).select("window_id", "ahu_id", "signature", "text_summary")
    q = out.writeStream.format("parquet").option(
        "checkpointLocation", f"{at}/state"
    ).trigger(availableNow=True).start(f"{at}/out")
    q.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{at}/out")
