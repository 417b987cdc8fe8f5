"""Evidence of every rule, in tables and lines, and hypotheses whose form changes from row to row."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airloom.config import Config
from airloom.operators import retrieval, rules, summary
from airloom.sources import readers

FEATURES = (
    "ahu_id string, sample_count long, missing_count long, cc_valve_mean double, sa_temp_slope double, "
    "sa_temp_mean_minus_sp double, sa_temp_delta double, sa_temp_mean double, sa_temp_sp_mean double, "
    "oa_damper_var double, oa_damper_mean double, avg_zone_temp_slope double, avg_zone_temp_delta double, "
    "avg_zone_temp_var double, sa_temp_min double, oa_temp_max double"
)


def fired(spark, cfg=Config(), **values):
    names = [f.split()[0] for f in FEATURES.split(", ")]
    d = spark.createDataFrame([tuple(values.get(n) for n in names)], FEATURES)
    return {a.rule_id: json.loads(a.evidence) for a in rules.with_anomalies(d, cfg).first().anomalies}


def test_missing_figures_are_null_zero_or_left_out(spark):
    cfg = Config().with_params("SAT_NOT_DROPPING_WHEN_VALVE_HIGH", sa_temp_mean_minus_sp_min=0.0)
    got = fired(spark, cfg, sample_count=5, missing_count=0, cc_valve_mean=80.0, sa_temp_slope=0.1)
    own = got["SAT_NOT_DROPPING_WHEN_VALVE_HIGH"]
    assert own == {
        "cc_valve_mean": 80.0,
        "sa_temp_slope": 0.1,
        "sa_temp_mean_minus_sp": 0.0,
        "thresholds": {"min_samples": 3, "sa_temp_mean_minus_sp_min": 0.0, "sat_slope_min": 0.0, "valve_high_pct": 70.0},
    }
    with_delta = fired(spark, cfg, sample_count=5, missing_count=0, cc_valve_mean=80.0, sa_temp_slope=0.1, sa_temp_delta=1.5)
    assert with_delta["SAT_NOT_DROPPING_WHEN_VALVE_HIGH"]["sa_temp_delta"] == 1.5
    high = fired(spark, sample_count=1, missing_count=0, cc_valve_mean=80.0, sa_temp_mean_minus_sp=3.0)
    assert high["SAT_TOO_HIGH_WHEN_VALVE_HIGH"] == {
        "cc_valve_mean": 80.0,
        "sa_temp_mean_minus_sp": 3.0,
        "sa_temp_mean": None,
        "sa_temp_sp_mean": None,
        "thresholds": {"sa_temp_mean_minus_sp_high": 1.0, "valve_high_pct": 70.0},
    }


def test_missing_data_and_offenders(spark):
    got = fired(spark, sample_count=4, missing_count=20, sa_temp_min=-3.0, oa_temp_max=99.0)
    assert got["MISSING_DATA_HIGH"] == {
        "missing_ratio": 0.5,
        "missing_count": 20,
        "sample_count": 4,
        "num_signals": 10,
        "thresholds": {"missing_ratio_high": 0.2},
    }
    assert got["OUT_OF_RANGE_VALUES"] == {
        "offenders": {
            "sa_temp_min": {"value": -3.0, "min": 10.0, "max": 20.0},
            "oa_temp_max": {"value": 99.0, "min": 10.0, "max": 45.0},
        }
    }
    open_ended = Config(signals={"sa_temp": (None, 10.0, None)}, cross={}, rules={"OUT_OF_RANGE_VALUES": Config().rules["OUT_OF_RANGE_VALUES"]})
    assert fired(spark, open_ended, sample_count=1, missing_count=0, sa_temp_min=1.0)["OUT_OF_RANGE_VALUES"] == {
        "offenders": {"sa_temp_min": {"value": 1.0, "min": 10.0, "max": None}}
    }


def test_lines_hold_evidence_as_objects_and_are_read_again(spark, tmp_path):
    d = spark.createDataFrame([("w1",), ("w2",)], "window_id string").withColumn(
        "anomalies", F.expr("array(named_struct('rule_id', 'R', 'evidence', '{\"b\": {\"c\": null}, \"a\": 1}'))")
    )
    line = json.loads(summary.json_lines(d).first().value)
    assert line["anomalies"][0]["evidence"] == {"a": 1, "b": {"c": None}}
    summary.json_lines(d).write.text(str(tmp_path / "x"))
    back = readers.jsonl_summaries(spark, str(tmp_path / "x")).first()
    assert json.loads(back.anomalies[0].evidence) == {"a": 1, "b": {"c": None}}


def test_values_of_evidence(spark):
    text = '{"n": 2, "t": "x", "o": {"p": {"q": 1.5, "r": null}, "s": true}, "z": null}'
    d = spark.createDataFrame([("w", ("R", text)), ("v", ("R", "broken"))], "w string, a struct<rule_id:string,evidence:string>")
    got = {(r.w, r.name): r.value for r in rules.evidence_values(d, "w").collect()}
    assert got == {("w", "n"): 2.0, ("w", "t"): None, ("w", "o.p.q"): 1.5, ("w", "o.p.r"): None, ("w", "o.s"): got["w", "o.s"], ("w", "z"): None}


@pytest.mark.parametrize(
    "value, names",
    [
        ('"a, b ,,c"', ["a", "b", "c"]),
        ('["a", " b ", "", null, 7]', ["a", "b"]),
        ('[{"x": 1, " y": {}}, "z", []]', ["x", "y", "z"]),
        ('{"h1": 0.5, "h0": 0.25}', ["h0", "h1"]),
        ("null", []),
        ("17", []),
        (None, []),
        ('["a,b"]', ["a,b"]),
    ],
)
def test_each_value_decides_its_form(spark, value, names):
    d = spark.createDataFrame([(value,)], "t string").select(F.parse_json("t").alias("v"))
    assert isinstance(d.schema["v"].dataType, T.VariantType)
    assert sorted(d.select(retrieval.hypothesis_tokens(F.col("v"), d.schema["v"].dataType)).first()[0]) == sorted(names)
