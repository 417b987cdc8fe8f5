"""Stores, tickets, diagnosis, settings and accounting against expectations worked out by hand."""

import json
import random

import pytest
from pyspark.sql import functions as F

from airloom import staging
from airloom.config import Config, Settings
from airloom.functions import scalars as S
from airloom.operators import diagnosis, live, manuals, normalize, ordering, retrieval, tickets
from airloom.sources import readers, sinks
from airloom.streaming import telemetry as streaming

from .test_engine import arrivals, rows


def test_settings_from_environment():
    assert Settings.from_env({}) == Settings()
    got = Settings.from_env(
        {
            "MAX_POINTS": "7",
            "MAX_MINS": "",
            "KAFKA_REPLAY_ON_STARTUP": " Yes ",
            "KAFKA_AUTO_OFFSET_RESET": "oldest",
            "KAFKA_TELEMETRY_TOPICS": "a, ,b",
            "KAFKA_CONSUMER_GROUP_PREFIX": " ",
        }
    )
    assert (
        got.max_points, got.max_mins, got.kafka_replay_on_startup, got.kafka_auto_offset_reset
    ) == (7, 120, True, "earliest")
    assert got.kafka_telemetry_topics == ("a", "b") and got.consumer_group("windows", 5) == "dashboard-windows-5"
    assert Settings().consumer_group("windows", 5) == "dashboard-windows"


def test_a_repeated_batch_changes_nothing_and_the_last_write_wins(spark, tmp_path):
    schema = "id string, v string, at int"
    write = sinks.collection_writer(str(tmp_path / "c"), order="at")
    write(spark.createDataFrame([("1", "old", 1), ("1", "new", 2), ("2", "x", 1)], schema), 0)
    write(spark.createDataFrame([("2", "y", 5)], schema), 1)
    write(spark.createDataFrame([("2", "repeated", 9)], schema), 1)
    assert rows(sinks.read_collection(spark, str(tmp_path / "c")), "id", "v") == [("1", "new"), ("2", "y")]
    plain = sinks.collection_writer(str(tmp_path / "d"))
    with pytest.raises(Exception, match="equal keys"):
        plain(spark.createDataFrame([("1", "a", 1), ("1", "b", 1)], schema), 0)


def test_stores_keep_what_they_retain(spark, tmp_path):
    t = spark.createDataFrame([(i, "a", 60 * i) for i in range(50)], "row_id long, ahu_id string, s long")
    t = t.withColumn("timestamp", F.timestamp_seconds("s"))
    write = sinks.telemetry_store(str(tmp_path / "t"), 10)
    write(t.where("row_id < 30"), 0)
    write(t.where("row_id >= 30"), 1)
    assert rows(sinks.read_collection(spark, str(tmp_path / "t")), "row_id") == [(i,) for i in range(39, 50)]
    w = spark.createDataFrame(
        [(f"w{i}", "a", i) for i in range(9)] + [("w8", "a", 20)], "window_id string, ahu_id string, arrival int"
    )
    sinks.window_store(str(tmp_path / "w"), "arrival", 3)(w, 0)
    assert rows(
        sinks.read_collection(spark, str(tmp_path / "w")), "window_id", "arrival"
    ) == [("w6", 6), ("w7", 7), ("w8", 20)]


def test_a_stream_of_windows_into_a_store(spark, tmp_path):
    good = {
        "window_id": "w1",
        "ahu_id": "a",
        "signature": "s",
        "time": {"start": "2025-01-01T00:00:00Z", "end": "2025-01-01T00:05:00Z"},
    }
    lines = [
        json.dumps(x)
        for x in (
            good, good | {"window_id": ""}, good | {"signature": None}, good | {"time": {"start": "x", "end": "y"}}
        )
    ] + ["no json"]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("\n".join(lines), encoding="utf-8")
    values = readers.json_stream(spark, str(tmp_path / "in"))
    events = streaming.window_events(values).select("window_id", "ahu_id", F.lit(1).alias("arrival"))
    q = streaming.start(
        events, sinks.window_store(str(tmp_path / "s"), "arrival"), str(tmp_path / "k"), until_idle=True
    )
    q.awaitTermination()
    assert rows(sinks.read_collection(spark, str(tmp_path / "s")), "window_id") == [("w1",)]
    (tmp_path / "in" / "b.txt").write_text(json.dumps(good | {"window_id": "w2"}), encoding="utf-8")
    anew = streaming.start(
        events, sinks.window_store(str(tmp_path / "s"), "arrival"), str(tmp_path / "k2"), until_idle=True
    )
    anew.awaitTermination()  # its first batch has the number of one written before
    assert rows(sinks.read_collection(spark, str(tmp_path / "s")), "window_id") == [("w1",), ("w2",)]


def test_printed_rows_and_counts(spark):
    d = spark.createDataFrame([(1, "x"), (2, "")], "b int, a string")
    out = []
    assert sinks.print_rows(d.orderBy("b"), show=out.append) == 2 and out[0] == '{"a":"x","b":1}'
    assert sinks.print_rows(d, pretty=True, show=out.append) == 2 and json.loads(out[-1]) in (
        {"a": "", "b": 2}, {"a": "x", "b": 1}
    )
    kept, seen = normalize.counted(d, F.col("a") != "", "n1")
    assert kept.count() == 1 and seen.get == {"consumed": 2, "indexed": 1, "skipped": 1}


TICKETS = "ticket_id string, ticket_ref string, incident_key string, ahu_id string, detected_fault_type string, lifecycle_status string, diagnosis_status string, review_status string, occurrence_count int, window_refs string, created_at string, last_seen_at string, updated_at string"


def test_new_tickets_need_unit_and_fault_and_known_states(spark):
    old = spark.createDataFrame(
        [("1", "TCK-0001", "a|F", "a", "F", "OPEN", "DRAFT", "NONE", 3, '["w"]', "2024", "2024", "2024")], TICKETS
    )
    patch = lambda *r: spark.createDataFrame(
        [r], "ticket_id string, seq int, ahu_id string, detected_fault_type string, lifecycle_status string"
    )
    with pytest.raises(Exception, match="a new ticket needs"):
        tickets.upsert(old, patch("2", 1, "b", None, None), "now").collect()
    with pytest.raises(Exception, match="lifecycle_status: CLOSED"):
        tickets.upsert(old, patch("1", 1, None, None, "CLOSED"), "now").collect()
    assert tickets.upsert(old, patch("2", 1, "b", None, None), "now", incomplete="leave out").count() == 1
    got = {r.ticket_id: r for r in tickets.upsert(old, patch("2", 1, "b", "G", None), "now").collect()}
    new = got["2"]
    assert (
        new.incident_key,
        new.lifecycle_status,
        new.diagnosis_status,
        new.review_status,
        new.occurrence_count,
        new.window_refs,
    ) == ("b|G", "OPEN", "DRAFT", "NONE", 0, "[]")
    assert new.ticket_ref.startswith("TCK-") and (
        new.created_at, new.last_seen_at, new.updated_at
    ) == ("now", "now", "now")
    assert got["1"].updated_at == "2024" and got["1"].window_refs == '["w"]'


def test_references_widen_where_they_meet(spark):
    ids = spark.createDataFrame([(f"t{i}",) for i in range(3000)], "ticket_id string")
    taken = ids.limit(1).select(S.ticket_ref(F.lit("t5")).alias("ticket_ref"))
    got = {r.ticket_id: r.ticket_ref for r in tickets.references(ids, taken).collect()}
    assert len(got) == len(set(got.values())) == 3000 and len(got["t5"]) > 8
    assert min(map(len, got.values())) == 8 and max(map(len, got.values())) > 8


def test_two_stages_call_the_reasoner_once_a_stage(spark):
    calls = []

    def reasoner(d):
        calls.append(1)
        return d.withColumns(
            {
                "title": F.lit("t"),
                "root_cause": F.lit("r"),
                "confidence": F.when(F.col("stage") == 1, F.col("c")).otherwise(0.9),
                "recommended_actions": F.array(F.lit("x")),
                "evidence_ids": F.array(F.lit("y")),
                "conflict": F.lit(False),
            }
        )

    d = spark.createDataFrame(
        [("1", "F", True, 0.85), ("2", "F", True, 0.84), ("3", "F", False, 0.99), ("4", "F", None, 0.99)],
        "ticket_id string, fault string, coverage_ok boolean, c double",
    )
    out = diagnosis.two_stages(d, reasoner)
    assert rows(out, "ticket_id", "stage", "reasoner_calls", "confidence") == [
        ("1", 1, 1, 0.85), ("2", 2, 2, 0.9), ("3", 2, 2, 0.9), ("4", 2, 2, 0.9)
    ]
    assert len(calls) == 2
    assert rows(diagnosis.two_stages(d, reasoner, allow_refine=False), "stage")[-1] == (1,)
    patch = diagnosis.ticket_patch(out, "now").orderBy("ticket_id").first()
    assert (patch.diagnosis_status, patch.recommended_actions, patch.evidence_ids) == ("DIAGNOSED", '["x"]', '["y"]')
    assert diagnosis.prompt("a {x} {y}", x="1", y=["ä"]) == 'a 1 ["ä"]'


def test_replies(spark):
    cases = {
        '{"title":"a","root_cause":"b","confidence":2,"conflict":"yes"}': ("a", 1.0, True),
        '{"title":"a","root_cause":"b","confidence":"x"}': None,
        '{"title":1,"root_cause":"b","confidence":0.1}': None,
        '{"title":"a","root_cause":"token limit","confidence":0.1}': None,
        '{"title":"a","root_cause":"b","confidence":0.1,"conflict":"maybe"}': None,
        'x {"title":"a","root_cause":"b","confidence":-1} {': ("a", 0.0, False),
        '[{"title":"a","root_cause":"b","confidence":0.5}]': None,
        "{bad} {}": None,
    }
    d = spark.createDataFrame([(r,) for r in cases], "reply string").withColumn(
        "allowed", F.array().cast("array<string>")
    )
    got = {r.reply: r for r in diagnosis.replies_to_results(d).collect()}
    for reply, want in cases.items():
        r = got[reply]
        assert (r.title, r.confidence, r.conflict) == (want or ("Uncertain diagnosis", 0.2, True))


def test_window_ids_and_symptoms(spark):
    schema = "window_id string, time struct<start:string,end:string>, text_summary string, anomalies array<struct<message:string,symptom:string>>"
    w = [
        (" w1 ", ("a", "b"), "", [("m1", "s1")]),
        (None, ("c", "d"), " ", [("", "s2"), (None, None)]),
        ("", (None, ""), None, [(" m3 ", "")]),
    ]
    d = spark.createDataFrame(
        [(w,), ([],)], f"windows array<struct<{', '.join(x.strip().replace(' ', ':', 1) for x in schema.split(', '))}>>"
    )
    ids = F.transform(
        "windows", lambda x, i: diagnosis.derived_window_id(x["window_id"], x["time"]["start"], x["time"]["end"], i)
    )
    got = d.select(
        ids.alias("ids"),
        diagnosis.symptom_summary(F.col("windows")).alias("s"),
        diagnosis.overall_time_range(F.col("windows")).alias("t"),
    ).collect()
    assert got[0].ids == ["w1", "window:c–d", "window:idx:2"] and got[0].s == "s2; m3" and tuple(got[0].t) == ("a", "d")
    assert got[1].s == "" and tuple(got[1].t) == (None, None)


def test_numeric_severities_in_history(spark):
    schema = "window_id string, ahu_id string, time struct<start:string,end:string>, signature string, text_summary string, features map<string,double>, stats struct<sample_count:long,missing_count:long,late_count:long,duplicate_count:long>, anomalies array<struct<rule_id:string,severity:string,message:string,symptom:string,fault_hypotheses:map<string,double>>>"
    row = (
        "",
        "a",
        ("2025-01-01T00:00:00Z", "x"),
        "s",
        None,
        {"b": 1.23456},
        (1, 0, 0, 0),
        [("R1", "2", "hot", None, {"coil": 0.5}), (None, "high", None, "s", {}), ("R3", "2.5", None, None, None)],
    )
    r = retrieval.history_documents(spark.createDataFrame([row], schema)).first()
    lines = r.text.split("\n")
    assert "ANOMALIES: R1 sev=2 msg=hot | msg=s | R3 sev=2.5" in lines and "MAX_SEVERITY: 2.5" in lines and "FEATURES: b=1.235" in lines
    assert r.metadata[
        "max_severity"
    ] == "2.5" and r.metadata["rule_ids"] == "R1,R3" and r.metadata["start_ts"] == "1735689600"
    assert "end_ts" not in r.metadata and r.metadata["incident_key"] == "a|coil" and len(r.id) == 40


def test_sections_of_texts_and_of_lines_are_the_same(spark):
    rnd = random.Random(3)
    pool = [
        "1. INTRODUCTION",
        "some plain words here, and more",
        "2) Next Part",
        "APPENDIX B",
        "",
        "  ",
        "lower case text that goes on and on",
    ]
    texts = ["\n".join(rnd.choice(pool) for _ in range(rnd.randrange(0, 12))) for _ in range(40)] + [None, "\r\n", "x"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    lines = d.select("doc_id", F.posexplode(F.split("text", manuals.LINE_END)).alias("line_no", "line"))
    cols = ("doc_id", "section", "heading", "body")
    assert rows(manuals.text_sections(d), *cols) == rows(manuals.sections(lines), *cols)
    plan = manuals.text_sections(d)._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Generate" in plan


@pytest.mark.parametrize("seed", range(3))
def test_accounting_in_small_blocks_equals_the_machine(spark, seed):
    a = arrivals(seed, 120)
    m = streaming.WindowMachine(20, 5)
    want = [w for _, ts, seq, k in a for w in m.push(ts, seq, k)] + list(m.flush())
    d = spark.createDataFrame(a, "unit string, ts_s long, seq long, key string")
    d = ordering.window_accounts(ordering.account(d, 20, 5, block_rows=7, block_sec=30))
    got = {r.window_s: (r.sample_count, r.duplicate_count, r.late_count) for r in d.collect()}
    assert got == {w: tuple(c) for w, *c in want if any(c)}


def test_active_incidents_read_their_windows_once(spark):
    schema = "window_id string, signature string, time struct<start:string,end:string>, anomalies array<struct<rule_id:string,severity:string>>"
    data = [
        ("w1", "s", ("1", "2"), [("b", "low"), ("a", "high")]),
        ("w2", "s", ("2", "3"), [("a", "low")]),
        ("w3", "t", ("0", "9"), []),
        ("w4", "", ("0", "9"), []),
    ]
    out = live.active_incidents(spark.createDataFrame(data, schema))
    got = [
        tuple(r)
        for r in out.select("signature", "first_seen", "last_seen", "count", "max_severity", "top_rules").collect()
    ]
    assert got == [("t", "0", "9", 1, 0, []), ("s", "1", "3", 2, 3, ["a", "b"])]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan") == 1 and "Join" not in plan


def test_typed_replay_and_staged_tables(spark, tmp_path):
    (tmp_path / "t.csv").write_text(
        "timestamp,ahu_id,sa_temp\n2025-01-01T00:00:00Z,1,15\n,2,16\n2025-01-01T00:01:00Z,1,none\n", encoding="utf-8"
    )
    d = readers.csv_events(spark, str(tmp_path / "t.csv"), typed=Config())
    assert [r.sa_temp for r in d.orderBy("timestamp").collect()] == [15.0, None]
    with pytest.raises(ValueError):
        readers.csv_events(spark, str(tmp_path / "t.csv"), required=("nope",))
    scratch = staging.Scratch(spark)
    a, b = scratch.keep(d, "a"), scratch.keep(d, "b")
    paths = [p for p, _ in scratch.paths.values()]
    scratch.drop(a)
    jvm = spark._jvm.org.apache.hadoop.fs
    there = lambda p: jvm.Path(p).getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm.Path(p))
    assert not there(paths[0]) and there(paths[1]) and b.count() == 2
