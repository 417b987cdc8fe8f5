"""Typed keyed state: windows, timers, incidents with guards; streams against their batch forms and plain machines."""

import random

import pytest
from pyspark.sql import functions as F

from airloom.config import Config, Windowing
from airloom.operators import gating, incidents, ordering, rules, summary, windows
from airloom.streaming import state
from airloom.streaming.machine import WindowMachine

from .test_engine import arrivals, rows

EVENTS = "unit string, ts long, seq long, key string, arrived timestamp, x double, y double"


def arrived_events(seeds, n=80):
    """Arrivals of several units with two signals, one arrival a second."""
    rnd = random.Random(sum(seeds))
    out = []
    for u, seed in enumerate(seeds):
        for _, ts, seq, key in arrivals(seed, n):
            x = None if rnd.random() < 0.2 else rnd.uniform(-5, 5)
            out.append((f"u{u}", ts * 1_000_000, seq * len(seeds) + u, key, x, rnd.uniform(0, 1) if u else None))
    return sorted(out, key=lambda r: r[2])


def frame(spark, events):
    d = spark.createDataFrame(events, "unit string, ts long, seq long, key string, x double, y double")
    return d.withColumn("arrived", F.timestamp_seconds(F.col("seq") + 1_000_000)).select(*[c.split()[0] for c in EVENTS.split(", ")])


def run(spark, tmp_path, batches, make, schema):
    """The stream over one file a batch."""
    src = tmp_path / "in"
    for i, b in enumerate(batches):
        b.coalesce(1).write.json(str(tmp_path / f"part{i}"))
        src.mkdir(exist_ok=True)
        for f in (tmp_path / f"part{i}").glob("*.json"):
            f.rename(src / f"{i:03d}.json")
            (src / f"{i:03d}.json").touch()
            import os

            os.utime(src / f"{i:03d}.json", (1_700_000_000 + i, 1_700_000_000 + i))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(src))
    return state.run_to_table(make(stream), str(tmp_path))


@pytest.mark.parametrize("files", [1, 4])
def test_windows_by_typed_state_equal_batch(spark, tmp_path, files):
    events = arrived_events((1, 2, 3))
    ends = [(f"u{u}", None, 10_000 + u, None, None, None) for u in range(3)]
    cut = [events[i * len(events) // files : (i + 1) * len(events) // files] for i in range(files)]
    cut[-1] = cut[-1] + ends
    got = run(spark, tmp_path, [frame(spark, c) for c in cut], lambda s: state.unit_windows(s, ("x", "y"), 20, 5), EVENTS)
    got = {(r.unit, r.window // 1_000_000): r for r in got.collect()}
    batch = frame(spark, events).withColumn("ts_s", F.expr("ts DIV 1000000"))
    fates = ordering.account(batch.select("unit", "ts_s", "seq", "key", "x", "y", "ts"), 20, 5)
    counts = {(r.unit, r.window_s): r for r in ordering.window_accounts(fates).collect()}
    for k, r in got.items():
        c = counts.get(k)
        want = (c.sample_count, c.duplicate_count, c.late_count) if c else (0, 0, 0)
        assert (r.sample_count, r.duplicate_count, r.late_count) == want, k
    assert {k for k, c in counts.items()} <= set(got)
    for u in range(3):  # no window between others is left out
        own = sorted(w for unit, w in got if unit == f"u{u}")
        assert own == list(range(own[0], own[-1] + 20, 20))
    cfg = Config(signals={"x": (None, None, None), "y": (None, None, None)}, cross={}, rules={}, windowing=Windowing(20))
    kept = fates.where("NOT dup AND NOT late").select(F.col("unit").alias("ahu_id"), F.timestamp_seconds("ts_s").alias("timestamp"), "x", "y")
    for r in windows.windowed(kept, cfg).withColumn("w", F.unix_timestamp("start")).collect():
        mine = got[(r.ahu_id, r.w)]
        assert mine.missing_count == r.missing_count
        for c in [f"{s}_{k}" for s in "xy" for k in windows.STATS]:
            if r[c] is None:
                assert mine[c] is None
            else:
                assert mine[c] == pytest.approx(r[c], abs=1e-9)


def test_silent_units_are_flushed_by_timer_and_state_can_be_read(spark, tmp_path):
    """No end marker: a clock unit goes on, the others' last windows come by timer, and equal all of the batch form's."""
    events = arrived_events((4, 5))
    last = events[-1][2]
    clock = [("clock", (10**6 + i * 600) * 10**6, last + 1 + i * 600, str(i), 1.0, 1.0) for i in range(3)]
    parts = [frame(spark, p) for p in (events[:70], events[70:], clock[:1], clock[1:2], clock[2:])]
    got = run(spark, tmp_path, parts, lambda s: state.unit_windows(s, ("x",), 20, 5, idle_sec=300, skew_sec=1), EVENTS)
    got = {(r.unit, r.window // 10**6): (r.sample_count, r.duplicate_count, r.late_count) for r in got.collect()}
    want = {}
    for u in ("u0", "u1"):
        m = WindowMachine(20, 5)
        own = [w for unit, ts, seq, k, *_ in events if unit == u for w in m.push(ts // 10**6, seq, k)] + list(m.flush())
        want |= {(u, w): tuple(c) for w, *c in own}
    assert {k: v for k, v in got.items() if k[0] != "clock"} == want
    at = str(tmp_path / "state")
    seen = spark.read.format("statestore").option("stateVarName", "seen").load(at)
    kept = {(r.key.unit, k) for r in seen.select("key", F.explode("user_map_value.keys").alias("k")).collect() for k in [r.k]}
    everything = {(e[0], e[3]) for e in events}
    assert kept and len(kept & everything) < len(everything) / 4  # keys of closed windows are gone
    unit = {r.key.unit: r.value for r in spark.read.format("statestore").option("stateVarName", "unit").load(at).collect()}
    assert unit["u0"].idle_at is None and unit["clock"].idle_at is not None


def test_summaries_by_state_equal_batch_with_gaps_and_gates(spark, tmp_path):
    rnd = random.Random(3)
    cfg = Config(windowing=Windowing(300))
    names = list(cfg.signals)
    data, t = [], 0
    for i in range(200):
        t += rnd.choice([20, 40, 60, 900])
        for u in "ab":
            values = [None if rnd.random() < 0.05 else rnd.uniform(10, 90) for _ in names]
            data.append((f"2025-01-01T00:00:00Z", u, t + (u == "b") * 7, 2 * i + (u == "b"), *values))
    schema = "base string, ahu_id string, off long, arrival long, " + ", ".join(f"{n} double" for n in names)
    d = spark.createDataFrame(data, schema).withColumn("timestamp", F.timestamp_seconds(F.lit(1_735_689_600) + F.col("off")))
    d = d.withColumn("timestamp_text", F.col("timestamp").cast("string")).drop("base", "off")
    offsets = [(0, 3000), (6000, 9000)]
    out = run(spark, tmp_path, [d.where("arrival < 150"), d.where("arrival >= 150")], lambda s: state.exact_summaries(s, cfg, 5, offsets), d.schema)
    got = {r.window_id: r for r in out.collect()}
    first = d.groupBy("ahu_id").agg(F.timestamp_seconds(F.min(F.expr("unix_timestamp(timestamp) - unix_timestamp(timestamp) % 300"))).alias("base_ts"))
    batch = windows.fill_gaps(windows.windowed(d, cfg), 300)
    batch = summary.summaries(gating.gate(rules.with_anomalies(batch, cfg), offsets, first), cfg)
    want = {r.window_id: r for r in batch.collect()}
    open_ones = {max(k for k in want if k.startswith(u)) for u in "ab"}
    assert set(want) - set(got) <= open_ones and set(got) <= set(want)
    assert any(not r.stats.sample_count for r in got.values()) and any(r.anomalies for r in got.values())
    for k, r in got.items():
        assert (r.time, r.stats, r.signature, r.text_summary) == (want[k].time, want[k].stats, want[k].signature, want[k].text_summary)
        assert r.features.keys() == want[k].features.keys()
        assert all(v == pytest.approx(want[k].features[f], abs=1e-6) for f, v in r.features.items())


SUMMARY = (
    "window_id string, ahu_id string, time struct<start:string,end:string>, signature string, text_summary string, "
    "anomalies array<struct<rule_id:string,fault_hypotheses:array<string>>>"
)
TOLD = "at string, ahu_id string, fault string, ticket_id string, lifecycle_status string, diagnosis_status string, occurrence_count long"
F1 = "OA_DAMPER_STUCK"


def window_rows(seen, unit="a", rule="OA_DAMPER_STUCK_OR_FLATLINE"):
    out = []
    for i, s in enumerate(seen):
        a = [(rule, [])] if s else []
        out.append((f"{unit}{i:02d}", unit, (f"T{i:02d}", f"T{i:02d}e"), f"s{i}", f"text {i}", a))
    return out


def changes(spark, tmp_path, batches, tickets=None, **more):
    """Changes of windows and updates that come in files of both, through one stream of mixed rows."""
    both = f"{SUMMARY}, {TOLD.replace('ahu_id string, ', '').replace('at string', 'at string')}"
    frames = []
    for ws, told in batches:
        w = spark.createDataFrame(ws, SUMMARY)
        t = spark.createDataFrame(told, TOLD)
        frames.append(w.unionByName(t, allowMissingColumns=True).select(*[c.strip().split()[0] for c in split_fields(both)]))

    def make(s):
        ups = s.where("at IS NOT NULL").select(*[c.split()[0] for c in TOLD.split(", ")])
        return state.incident_changes(s.where("at IS NULL"), tickets, ups, **more)

    out = run(spark, tmp_path, frames, make, frames[0].schema)
    return rows(out, "ahu_id", "window_id", "fault", "change", "occurrence_count", "diagnose"), out


def split_fields(schema):
    depth, out, word = 0, [], ""
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(word)
            word = ""
        else:
            word += c
    return [*out, word]


def test_incidents_open_run_and_resolve_across_batches(spark, tmp_path):
    ws = window_rows([1, 1, 1, 0, 1, 0, 0, 0, 1, 1])
    got, out = changes(spark, tmp_path, [(ws[:2], []), (ws[2:6], [("T03", "a", F1, None, None, "DIAGNOSED", None)]), (ws[6:], [])])
    assert got == [
        ("a", "a01", F1, "opened", 1, True),
        ("a", "a02", F1, "seen", 2, False),
        ("a", "a04", F1, "seen", 3, False),
        ("a", "a07", F1, "resolved", 3, False),
        ("a", "a09", F1, "opened", 1, True),
    ]
    first = out.where("window_id = 'a02'").first()
    assert first.window_refs == ["a01", "a02"] and first.signatures_seen == ["s1", "s2"] and first.symptom_summary == "text 2"
    assert out.select("ticket_id").distinct().count() == 2


def test_open_tickets_are_taken_up_and_a_diagnosis_delays(spark, tmp_path):
    tickets = spark.createDataFrame(
        [("a", F1, "t9", "DIAGNOSED", 4, "OPEN"), ("b", F1, "t7", "DRAFT", None, "RESOLVED"), ("c", F1, "t1", "DRAFT", 0, "OPEN")],
        "ahu_id string, detected_fault_type string, ticket_id string, diagnosis_status string, occurrence_count long, lifecycle_status string",
    )
    ws = window_rows([1, 0, 0, 0, 1]) + window_rows([1, 1], "b") + window_rows([1, 1, 0, 0, 0, 0, 0], "c")
    told = [("T04", "a", F1, "t5", "OPEN", "DRAFT", 2), ("T05", "c", None, None, None, "FAILED", None)]
    got, _ = changes(spark, tmp_path, [(ws, told)], tickets)
    assert got == [
        ("a", "a00", F1, "taken up", 5, False),
        ("a", "a03", F1, "resolved", 5, False),
        ("a", "a04", F1, "taken up", 3, False),
        ("b", "b01", F1, "opened", 1, True),
        ("c", "c00", F1, "taken up", 1, False),
        ("c", "c01", F1, "seen", 2, True),
        ("c", "c04", F1, "delayed", 2, False),
        ("c", "c05", F1, "resolved", 2, False),
    ]


def test_forced_diagnosis_and_episodes_of_the_batch_form(spark, tmp_path):
    """Without guards the stream opens, counts and resolves as ``incidents.episodes`` does."""
    rnd = random.Random(8)
    seen = [rnd.random() < 0.5 for _ in range(60)]
    told = [(f"T{i:02d}", "a", F1, None, None, "DIAGNOSED", None) for i in range(0, 60)]
    got, _ = changes(spark, tmp_path, [(window_rows(seen), told)], forced=True)
    w = spark.createDataFrame([("a", i, [F1] if s else []) for i, s in enumerate(seen)], "ahu_id string, i int, faults array<string>")
    want = {(r.opened_at, r.resolved_at, r.occurrence_count) for r in incidents.episodes(incidents.streaks(incidents.presence(w))).collect()}
    found, opened = set(), None
    for _, window, _, change, n, _ in got:
        if change == "opened":
            opened = int(window[1:])
        if change == "resolved":
            found.add((opened, int(window[1:]), n))
            opened = None
        last = n
    if opened is not None:
        found.add((opened, None, last))
    assert found == want
    diagnosed = [g for g in got if g[5]]
    assert len(diagnosed) > len([g for g in got if g[3] == "opened"])  # forced: again while it goes on
