"""Micro-fixtures with expectations worked out by hand, and batch against stream."""

import json
import random

import pytest
from pyspark.sql import functions as F

from airloom.config import Config, Windowing, load_scenario
from airloom.functions import scalars as S
from airloom.operators import gating, incidents, live, manuals, normalize, ordering, retrieval, rules, summary, tickets, windows
from airloom.sources import readers, simulate, sinks
from airloom.streaming import telemetry as streaming


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.select(*cols).collect())


def test_float_coercion(spark):
    cases = {
        " 1.5 ": 1.5,
        "": None,
        "nan": None,
        "NULL": None,
        "None": None,
        "NaN": None,
        "true": 1.0,
        "False": 0.0,
        "x1": None,
        "1e3": 1000.0,
    }
    d = spark.createDataFrame([(k,) for k in cases], "s string")
    assert {r.s: r.v for r in d.select("s", S.to_float(F.col("s")).alias("v")).collect()} == cases


def test_timestamps_are_utc(spark):
    d = spark.createDataFrame(
        [
            ("2025-01-01T00:00:00Z",),
            ("2025-01-01 00:00:00",),
            ("2025-01-01T01:00:00+01:00",),
            ("2025",),
            ("T09:00",),
            ("",),
        ],
        "s string",
    )
    got = [r[0] for r in d.select(F.unix_timestamp(S.to_timestamp(F.col("s")))).collect()]
    assert got == [1735689600, 1735689600, 1735689600, None, None, None]


def test_normalize_nested_flat_and_missing(spark):
    lines = [
        '{"timestamp":"2025-01-01T00:00:00Z","ahu_id":1,"signals":{"sa_temp":"15","junk":"3"}}',
        '{"ts":"2025-01-01T00:01:00Z","ahu_id":"2","cc_valve":"none","sa_temp":16}',
        "not json",
        "[1]",
        '{"ahu_id":"3"}',
        '{"timestamp":"2025-01-01T00:00:00Z"}',
        '{"timestamp":" ","ts":"2025-01-01T00:02:00Z","ahu_id":0,"values":{"cc_valve":7}}',
    ]
    d = normalize.normalize_events(normalize.parse_json(spark.createDataFrame([(x,) for x in lines], "value string")))
    assert rows(d, "ahu_id", "timestamp_text") == [
        ("0", "2025-01-01T00:02:00Z"), ("1", "2025-01-01T00:00:00Z"), ("2", "2025-01-01T00:01:00Z")
    ]
    assert {r.ahu_id: r.sa_temp for r in d.collect()}["2"] == 16.0


def test_window_features_and_gaps(spark):
    ev = spark.createDataFrame(
        [("a", 0, 1.0), ("a", 60, 2.0), ("a", 120, None), ("a", 180, 4.0), ("a", 1000, 7.0)],
        "ahu_id string, s long, sa_temp double",
    ).select("ahu_id", F.timestamp_seconds("s").alias("timestamp"), "sa_temp")
    cfg = Config(signals={"sa_temp": ("C", 10, 20)}, cross={})
    w = windows.windowed(ev, cfg).orderBy("start").collect()
    assert (w[0].sample_count, w[0].missing_count, w[0].sa_temp_delta, round(w[0].sa_temp_slope, 9)) == (4, 1, 3.0, 1.0)
    assert w[0].sa_temp_mean == pytest.approx(7 / 3) and w[0].sa_temp_var == pytest.approx(14 / 9)
    assert w[1].sa_temp_delta is None and w[1].sa_temp_slope is None
    full = windows.fill_gaps(windows.windowed(ev, cfg), 300).select(
        F.unix_timestamp("start").alias("s"), "sample_count"
    )
    assert rows(full, "s", "sample_count") == [(0, 4), (300, 0), (600, 0), (900, 1)]
    assert rows(windows.unaligned_start(ev, 300).select(F.unix_timestamp("start").alias("s")), "s")[-1] == (900,)


def test_rules_need_their_inputs(spark):
    base = {
        "sample_count": 5,
        "missing_count": 0,
        "cc_valve_mean": 80.0,
        "sa_temp_slope": 0.0,
        "sa_temp_mean_minus_sp": 1.0,
        "oa_damper_var": 0.05,
        "ra_damper_var": 0.0,
        "avg_zone_temp_slope": 0.01,
        "avg_zone_temp_delta": None,
        "avg_zone_temp_var": 0.25,
    }
    schema = "sample_count long, missing_count long, cc_valve_mean double, sa_temp_slope double, sa_temp_mean_minus_sp double, oa_damper_var double, ra_damper_var double, avg_zone_temp_slope double, avg_zone_temp_delta double, avg_zone_temp_var double"
    cases = [
        base,
        base | {"sa_temp_mean_minus_sp": None, "avg_zone_temp_delta": 0.06},
        base | {"sample_count": 2, "missing_count": 5, "sa_temp_mean_minus_sp": 1.1},
        {k: None for k in base} | {"sample_count": 0, "missing_count": 0},
    ]
    d = rules.with_anomalies(spark.createDataFrame([tuple(c[k] for k in base) for c in cases], schema), Config())
    assert [r.ids for r in d.select(F.col("anomalies.rule_id").alias("ids")).collect()] == [
        ["SAT_NOT_DROPPING_WHEN_VALVE_HIGH", "RA_DAMPER_STUCK_OR_FLATLINE"],
        ["RA_DAMPER_STUCK_OR_FLATLINE", "ZONE_TEMP_PERSISTENT_TREND"],
        ["SAT_TOO_HIGH_WHEN_VALVE_HIGH", "RA_DAMPER_STUCK_OR_FLATLINE", "MISSING_DATA_HIGH"],
        [],
    ]


def test_signature_ignores_order(spark):
    d = spark.createDataFrame(
        [(["b", "a"],), (["a", "b", "a"],), ([],)], "r array<string>"
    ).select(S.signature(F.col("r")).alias("s")).collect()
    assert d[0].s == d[1].s and d[2].s.startswith("e3b0c442")


def test_fixed_format_rounds_the_binary_value(spark):
    d = spark.createDataFrame([(2.675,), (0.125,), (0.25,), (None,)], "x double")
    assert [r[0] for r in d.select(S.fixed(2)("x")).collect()] == ["2.67", "0.12", "0.25", "n/a"]


def arrivals(seed, n=60):
    rnd = random.Random(seed)
    t, out = 0, []
    for i in range(n):
        t += rnd.choice([1, 2, 3, 5, 40])
        out.append(("u", t - rnd.choice([0, 0, 0, 4, 9, 25]), i, None))
    return [(u, ts, i, str(ts)) for u, ts, i, _ in out]


@pytest.mark.parametrize("seed", range(4))
def test_batch_accounting_equals_the_machine(spark, seed):
    a = arrivals(seed)
    m = streaming.WindowMachine(20, 5)
    want = [w for _, ts, seq, k in a for w in m.push(ts, seq, k)] + list(m.flush())
    d = ordering.window_accounts(
        ordering.account(spark.createDataFrame(a, "unit string, ts_s long, seq long, key string"), 20, 5)
    )
    got = {r.window_s: (r.sample_count, r.duplicate_count, r.late_count) for r in d.collect()}
    assert got == {w: tuple(c) for w, *c in want if any(c)}


def test_stream_accounting_and_summaries(spark, tmp_path):
    a = arrivals(9) + [("u", None, 10_000, None)]
    src = tmp_path / "in"
    spark.createDataFrame(a, "unit string, ts_s long, seq long, key string").coalesce(1).write.json(str(src))
    s = spark.readStream.schema("unit string, ts_s long, seq long, key string").json(str(src))
    q = streaming.account(s, 20, 5, bounded=False).writeStream.format("parquet").option(
        "checkpointLocation", str(tmp_path / "c")
    ).trigger(availableNow=True).start(str(tmp_path / "out"))
    q.awaitTermination()
    m = streaming.WindowMachine(20, 5)
    want = [w for _, ts, seq, k in a[:-1] for w in m.push(ts, seq, k)] + list(m.flush())
    assert rows(
        spark.read.parquet(str(tmp_path / "out")), "window_s", "sample_count", "duplicate_count", "late_count"
    ) == sorted(want)


def test_episodes_open_and_resolve(spark):
    seen = [1, 1, 0, 1, 0, 0, 0, 1, 1, 1]
    w = spark.createDataFrame(
        [("a", i, ["F"] if s else []) for i, s in enumerate(seen)], "ahu_id string, i int, faults array<string>"
    )
    e = incidents.episodes(incidents.streaks(incidents.presence(w)))
    assert rows(
        e.na.fill(-1), "episode", "opened_at", "resolved_at", "occurrence_count"
    ) == [(1, 1, 6, 2), (2, 8, -1, 2)]


def test_fault_mapping(spark):
    d = spark.createDataFrame(
        [
            ("cooling_coil_fault",),
            ("OA damper stuck",),
            ("return damper flatline",),
            ("zone temp drift",),
            ("data_quality",),
            ("",),
        ],
        "t string",
    )
    assert [r[0] for r in d.select(incidents.hypothesis_fault(F.col("t"))).collect()] == [
        "COOLING_COIL_FAULT", "OA_DAMPER_STUCK", "RA_DAMPER_STUCK", "ZONE_TEMP_SENSOR_DRIFT", "UNKNOWN", None
    ]


def test_downsample_and_gating(spark):
    d = spark.createDataFrame([("a", i) for i in range(10)], "k string, t int")
    assert rows(live.downsample(d, "k", ["t"], 4), "t") == [(0,), (3,), (6,), (9,)]
    e = spark.createDataFrame([(0.5, 10.0, 300.0), (1.5, 0.0, 5.0)], "m double, r double, s double")
    assert [
        r[0] for r in e.select(gating.effective_magnitude(F.col("m"), F.col("r"), F.col("s"))).collect()
    ] == [0.25, 1.0]


def test_ticket_errors(spark):
    t = spark.createDataFrame([("1", "OPEN")], "ticket_id string, lifecycle_status string")
    with pytest.raises(ValueError):
        tickets.list_tickets(t, lifecycle_status="CLOSED")
    assert tickets.like_pattern("a%b_c\\") == "%a\\%b\\_c\\\\%"
    with pytest.raises(KeyError):
        tickets.review(t.withColumn("review_status", F.lit("NONE")), "9", "APPROVED", None, "now")


def test_manual_chunks(spark):
    body = " ".join(f"w{i}" for i in range(700))
    lines = ["1. INTRODUCTION", "few words only here", "2. Startup Procedure", "3. Fault Table", body]
    d = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "doc_id int, line_no int, line string")
    assert [
        r.heading for r in manuals.sections(d).orderBy("section").collect()
    ] == ["1. INTRODUCTION", "3. Fault Table"]
    c = manuals.manual_chunks(d, 300, 100).orderBy("id").collect()
    assert all(
        len(r.chunk.split()) >= 30 and r.chunk_type == "fault_table" for r in c
    ) and c[0].chunk.startswith("3. Fault Table")
    assert c[-1].chunk.endswith("w699")
    pages = spark.createDataFrame(
        [("d", 1, "Head\nalpha\n12"), ("d", 2, "Head\nbeta"), ("d", 3, "gamma")],
        "doc_id string, page_no int, text string",
    )
    assert rows(manuals.clean_pages(pages), "page_no", "text") == [(1, "alpha"), (2, "beta"), (3, "gamma")]


def test_readers_and_sinks(spark, tmp_path):
    d = spark.createDataFrame([("a=1 | b = x=y | note",)], "line string")
    assert d.select(readers.kv_line(F.col("line")).alias("m")).first().m == {"a": "1", "b": "x=y"}
    e = spark.createDataFrame([("1", "x"), ("2", "y")], "id string, v string")
    write = sinks.collection_writer(str(tmp_path / "c"))  # keys differ inside each batch
    write(e, 0)
    write(spark.createDataFrame([("2", "z"), ("3", "w")], "id string, v string"), 1)
    assert rows(sinks.read_collection(spark, str(tmp_path / "c")), "id", "v") == [("1", "x"), ("2", "z"), ("3", "w")]
    with pytest.raises(ValueError):
        sinks.write_csv(e, str(tmp_path / "x"), ["nope"])
    found = spark.createDataFrame(
        [('say {"a": "}"} end',), ("none",)], "t string"
    ).select(S.first_json_object("t").alias("j")).collect()
    assert json.loads(found[0].j) == {"a": "}"} and found[1].j is None


def scenario():
    ep = lambda i, k, a, b, m, **p: {
        "episode_id": i,
        "fault_type": k,
        "start_time": f"2025-12-01T{a}:00Z",
        "end_time": f"2025-12-01T{b}:00Z",
        "magnitude": m,
        "target_signals": [],
        "fault_params": p,
    }
    return {
        "run_id": "r",
        "scenario_name": "s",
        "ahu_id": 1,
        "start_time": "2025-12-01T09:00:00Z",
        "end_time": "2025-12-01T15:00:00Z",
        "sampling_interval_sec": 60,
        "seed": 42,
        "signals": [],
        "fault_episodes": [
            ep("F1", "cooling_coil_fault", "10:30", "12:00", 0.7, ramp_minutes=5),
            ep("F2", "stuck_damper_fault", "13:00", "14:10", 1.0, damper="oa_damper", stuck_value=100.0),
            ep("F3", "zone_temp_sensor_drift", "14:30", "15:00", 0.3, drift_c_per_hour=4.0),
        ],
    }


def test_simulated_faults_fire_their_rules(spark, tmp_path):
    path = tmp_path / "s.json"
    path.write_text(json.dumps(scenario()))
    s = load_scenario(str(path))
    d = simulate.simulate(spark, [s])
    assert d.count() == 360 and d.collect() == simulate.simulate(spark, [s]).collect()
    cfg = Config(windowing=Windowing(300))
    out = summary.summaries(rules.with_anomalies(windows.windowed(normalize.normalize_events(d), cfg), cfg), cfg)
    assert out.count() == 72
    ids = {
        r.start[11:16]: set(r.ids)
        for r in out.select(F.col("time.start").alias("start"), F.col("anomalies.rule_id").alias("ids")).collect()
    }
    assert "SAT_TOO_HIGH_WHEN_VALVE_HIGH" in ids["11:00"] and "OA_DAMPER_STUCK_OR_FLATLINE" in ids[
        "13:30"
    ] and not ids["09:30"] & {"OA_DAMPER_STUCK_OR_FLATLINE", "SAT_TOO_HIGH_WHEN_VALVE_HIGH"}
    bad = scenario()
    bad["fault_episodes"][1]["start_time"] = "2025-12-01T11:00:00Z"
    path.write_text(json.dumps(bad))
    with pytest.raises(ValueError, match="overlaps"):
        load_scenario(str(path))
    docs = retrieval.history_documents(out)
    assert docs.where("text LIKE 'WINDOW: ahu=1 %'").count() == 72 and docs.where(
        "metadata['source'] = 'window_history'"
    ).count() == 72
