"""Configuration files, document readers, file sinks and keyed incident state."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from airloom import config
from airloom.operators import diagnosis, manuals, normalize, retrieval
from airloom.sources import readers, sinks
from airloom.streaming import telemetry as streaming

from .test_engine import rows

YAML = {
    "signals.yaml": "schema: {timestamp_field: when, ahu_id_field: unit}\nsignals:\n  sa_temp: {unit: C, min: 10, max: 20}\n"
    "features:\n  cross_signal:\n    - {name: x, expr: sa_temp_mean - sa_temp_min}\n",
    "windowing.yaml": "windowing: {window_type: sliding, window_size_sec: 600, step_sec: 300, align_to_epoch: true}\n"
    "ordering: {reorder_buffer_sec: 7}\nmissing_data: {drop_event_if_missing_ahu_id: false, allow_missing_values: false}\n",
    "rules.yaml": "rules:\n  SAT_TOO_HIGH_WHEN_VALVE_HIGH: {enabled: false, severity: high, symptom: s, fault_hypotheses: [a, b], params: {valve_high_pct: 1}}\n",
}


def test_configuration_files(tmp_path):
    for name, text in YAML.items():
        (tmp_path / name).write_text(text, encoding="utf-8")
    cfg, sha = config.load_folder(str(tmp_path))
    assert cfg.signals == {"sa_temp": ("C", 10, 20)} and cfg.cross == {"x": "sa_temp_mean - sa_temp_min"}
    assert (cfg.timestamp_field, cfg.unit_field, cfg.reorder_sec) == ("when", "unit", 7)
    assert (cfg.windowing.size_sec, cfg.windowing.step_sec, cfg.windowing.kind) == (600, 300, "sliding")
    assert (cfg.allow_missing_values, cfg.drop_if_missing_timestamp, cfg.drop_if_missing_unit) == (False, True, False)
    rule = cfg.rules["SAT_TOO_HIGH_WHEN_VALVE_HIGH"]
    assert (rule.enabled, rule.severity, rule.hypotheses, rule.params) == (False, "high", ("a", "b"), {"valve_high_pct": 1})
    whole = b"".join((tmp_path / n).as_posix().encode() + b"\n" + YAML[n].encode() + b"\n" for n in sorted(YAML))
    assert sha == hashlib.sha256(whole).hexdigest()
    (tmp_path / "rules.yaml").unlink()
    with pytest.raises(FileNotFoundError):
        config.load_folder(str(tmp_path))
    (tmp_path / "e.yaml").write_text("")
    (tmp_path / "l.yaml").write_text("- 1\n")
    assert config.load_yaml(str(tmp_path / "e.yaml")) == {}
    with pytest.raises(ValueError):
        config.load_yaml(str(tmp_path / "l.yaml"))


def summary(window_id, **more):
    own = {"window_id": window_id, "ahu_id": "a", "signature": "s", "time": {"start": "2025-01-01T00:00:00Z", "end": "2025-01-01T00:05:00Z"}}
    return own | {"anomalies": [], "features": {"b": 1.0, "a": 2.0}} | more


def test_summary_lines_round_trip(spark, tmp_path):
    path = tmp_path / "s.jsonl"
    path.write_text("\n".join([json.dumps(summary("w1")), "{broken", json.dumps(summary("w2"))]), encoding="utf-8")
    d = readers.jsonl_summaries(spark, str(path))
    assert rows(d, "window_id") == [("w1",), ("w2",)] and readers.jsonl_summaries(spark, str(path), most=1).count() == 1
    with pytest.raises(Exception, match="MALFORMED"):
        readers.jsonl_summaries(spark, str(path), strict=True).collect()
    sinks.write_jsonl(d, str(tmp_path / "out"))
    again = readers.jsonl_summaries(spark, str(tmp_path / "out"))
    assert sorted(map(str, again.collect())) == sorted(map(str, d.collect()))


def test_document_readers(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps([{"doc_id": "d1", "file_name": "a.pdf", "fault_types": ["x"]}, {"doc_id": "d2", "file_name": "b.pdf"}]))
    meta = readers.documents_metadata(spark, str(tmp_path / "m.json"))
    files = spark.createDataFrame([("a.pdf", 3), ("c.pdf", 1)], "file_name string, pages int")
    assert rows(manuals.attach_metadata(files, meta), "file_name", "doc_id", "pages") == [("a.pdf", "d1", 3)]
    cases = [{"case_id": "C1", "symptoms": ["s", "t"], "window_pattern": {"severity": "low"}}, {"case_id": " "}, {"fault_type": "x"}]
    (tmp_path / "c.jsonl").write_text("\n".join(map(json.dumps, cases)))
    got = retrieval.case_documents(readers.past_cases(spark, str(tmp_path / "c.jsonl"))).collect()
    assert [r.id for r in got] == ["C1"] and "SYMPTOMS: s|t\nWINDOW_PATTERN: persistence=, severity=low, notes=\n" in got[0].text
    (tmp_path / "docs.csv").write_text('file,tags\na.pdf,x|y\n"b\nb.pdf",z\n')
    d = readers.manifest(spark, str(tmp_path / "docs.csv"), ("tags",))
    assert [tuple(r.tags) for r in d.orderBy("file").collect()] == [("x", "y"), ("z",)]


def test_tee_and_metadata(spark, tmp_path):
    seen = []
    d = spark.createDataFrame([("1", "x")], "id string, v string")
    sinks.tee(lambda b, i: seen.append((b.count(), i)), sinks.collection_writer(str(tmp_path / "c")))(d, 4)
    assert seen == [(1, 4)] and sinks.read_collection(spark, str(tmp_path / "c")).count() == 1
    sinks.write_metadata({"b": 1, "a": "ä"}, str(tmp_path / "m.json"))
    assert json.loads((tmp_path / "m.json").read_text(encoding="utf-8")) == {"a": "ä", "b": 1}


def test_free_form_values(spark):
    d = normalize.parse_json(spark.createDataFrame([('{"ts":"2025-01-01T00:00:00Z","ahu_id":"1","values":{"x":"1.5","y":"none","z":true}}',)], "value string"))
    assert normalize.free_form_values(d).first()["values"] == {"x": 1.5, "z": 1.0}
    only = d.select(F.col("ahu_id"), F.lit(" ").alias("b"))
    assert normalize.with_required(only, "ahu_id").count() == 1 and normalize.with_required(only, "b").count() == 0
    assert [r[0] for r in only.select(retrieval.allowed_only(F.array(*map(F.lit, "aba")), F.array(F.lit("a")))).collect()] == [["a", "a"]]


def test_ticket_changes_by_keyed_state(spark, tmp_path):
    """A fault opens a ticket at the second window in a row and resolves it at the third clear one."""
    seen = [1, 1, 0, 1, 0, 0, 0, 1]
    lines = []
    for i, s in enumerate(seen):
        a = [{"rule_id": "OA_DAMPER_STUCK_OR_FLATLINE", "severity": "low", "fault_hypotheses": []}] if s else []
        t = {"start": f"2025-01-01T0{i}:00:00Z", "end": f"2025-01-01T0{i}:30:00Z"}
        lines.append(json.dumps(summary(f"w{i}", time=t, anomalies=a)))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("\n".join(lines), encoding="utf-8")
    events = streaming.window_events(readers.json_stream(spark, str(tmp_path / "in")))
    out = streaming.ticket_changes(events).writeStream.format("parquet").trigger(availableNow=True)
    q = out.option("checkpointLocation", str(tmp_path / "k")).start(str(tmp_path / "out"))
    q.awaitTermination()
    got = rows(spark.read.parquet(str(tmp_path / "out")), "window_id", "fault", "change", "occurrence_count")
    assert got == [("w1", "OA_DAMPER_STUCK", "opened", 1), ("w3", "OA_DAMPER_STUCK", "seen", 2), ("w6", "OA_DAMPER_STUCK", "resolved", 2)]


def test_triggers_only_while_a_draft(spark):
    seen = [0, 1, 1, 1, 0, 0, 0, 1, 1]
    d = spark.createDataFrame([("a", "F", i, bool(s), n) for i, (s, n) in enumerate(zip(seen, [1, 1, 2, 3, 1, 2, 3, 1, 2]))], "ahu_id string, fault string, i int, s boolean, rl int")
    assert rows(diagnosis.diagnosis_triggers(d), "episode", "i") == [(1, 2), (2, 8)]
    later = d.withColumn("diagnosis_status", F.when(F.col("i") < 5, "DIAGNOSED").otherwise("DRAFT"))
    assert rows(diagnosis.diagnosis_triggers(later), "episode", "i") == [(2, 8)]
