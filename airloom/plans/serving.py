"""Queries of the serving side, of diagnosis, of manuals and of intake, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import CROSS_FEATURES, Config
from ..functions import labels
from ..functions import scalars as S
from ..operators import diagnosis, gating, incidents, live, manuals, normalize, ordering, retrieval, tickets, windows
from ..sources import adapter, readers
from ..sources.adapter import TELEMETRY_SQL, read, telemetry
from . import telemetry as base
from .text import _HEAD, _SECT

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
SIZE, AS_OF = base.SIZE, "2024-01-15 00:00:00"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _text_of_windows(spark, sf: str) -> DataFrame:
    return base._summ(spark, sf)


_SUMM = base.SUMM_SQL + f", tx AS (SELECT *, {base._TEXT_SQL} AS text FROM summ)"
_iso_ts = "strftime(ts, '%Y-%m-%dT%H:%M:%SZ')"

# --- live views

_PICKED = {
    "sat": "sa_temp",
    "rat": "coalesce(ra_temp, avg_zone_temp)",
    "valve_pos": "cc_valve",
    "fan_speed": "sa_fan_speed",
    "damper_pos": "oa_damper",
    "oat": "oa_temp",
}


@query(f"WITH {TELEMETRY_SQL} SELECT event_id, " + ", ".join(f"{x} AS {n}" for n, x in _PICKED.items()) + " FROM tel")
def q59_signal_aliases(spark, sf):
    t = telemetry(spark, sf)
    return t.select("event_id", *[live.pick(t, n).alias(n) for n in _PICKED])


@query(
    f"""WITH {_SUMM}, n AS (SELECT ahu_id, max(ts) AS ts, arg_max({{'a': sa_temp, 'b': coalesce(ra_temp,
    avg_zone_temp), 'c': cc_valve,
  'd': sa_fan_speed}}, ts) AS v FROM tel GROUP BY 1), w AS (SELECT *
  FROM (SELECT *, row_number() OVER (PARTITION BY ahu_id ORDER BY start_s DESC) AS r FROM tx) WHERE r = 1)
SELECT ahu_id, epoch(TIMESTAMP '{AS_OF}') - epoch(date_trunc('second', ts)) <= 15 AS system_online,
  {_iso_ts} AS last_updated, v.a AS sat, v.b AS rat, v.c AS valve_pos, v.d AS fan_speed,
  text AS diagnosis, NULL::DOUBLE AS confidence, max_severity AS severity, window_id AS active_window_id FROM n FULL
  JOIN w USING (ahu_id)"""
)
def q60_live_overview(spark, sf):
    return live.overview(telemetry(spark, sf), _text_of_windows(spark, sf), AS_OF)


_RESOLVED = """newest AS (SELECT ahu_id, max(ts) AS newest,
  arg_max({'sat': sa_temp, 'ra': ra_temp, 'zone': avg_zone_temp, 'oat': oa_temp}, ts) AS v FROM tel GROUP BY 1),
res AS (SELECT tel.*, newest, CASE WHEN v.sat IS NOT NULL THEN sa_temp END AS sat, CASE
  WHEN v.ra IS NOT NULL THEN ra_temp ELSE avg_zone_temp END AS rat,
  CASE WHEN v.oat IS NOT NULL THEN oa_temp END AS oat, NULL::DOUBLE AS other FROM tel JOIN newest USING (ahu_id))"""
_NAMES = ["sat", "rat", "oat", "other"]


@query(
    f"""WITH {TELEMETRY_SQL}, {_RESOLVED}, u AS (SELECT *, CASE
    WHEN newest < TIMESTAMP '{AS_OF}' - INTERVAL 120 MINUTES THEN newest ELSE TIMESTAMP '{AS_OF}' END AS until
    FROM res),
d AS (SELECT *, count(*) OVER (PARTITION BY ahu_id) AS n, row_number() OVER (PARTITION BY ahu_id ORDER BY ts) AS i
  FROM u WHERE ts BETWEEN until - INTERVAL 120 MINUTES AND until)
SELECT ahu_id, {_iso_ts} AS ts, sat, rat, oat, other FROM d WHERE (i - 1) % (CASE WHEN n <= 7 THEN 1
  ELSE ceil(n / 7.0)::BIGINT END) = 0 OR i = n"""
)
def q61_timeseries(spark, sf):
    return live.timeseries(telemetry(spark, sf), 500, _NAMES, AS_OF, 7)


@query(
    f"""WITH {TELEMETRY_SQL}, {_RESOLVED} SELECT ahu_id, {_iso_ts} AS ts, rn::INT AS rn, sat, rat, oat, other
FROM (SELECT *, row_number() OVER (PARTITION BY ahu_id ORDER BY ts DESC) AS rn FROM res) WHERE rn <= 30"""
)
def q62_last_points(spark, sf):
    return live.last_points(telemetry(spark, sf), 30, _NAMES)


@query(
    f"""WITH {_SUMM} SELECT ahu_id, rn::INT AS rn, window_id, t0 AS start_ts, t1 AS end_ts, max_severity AS severity,
    text AS diagnosis
FROM (SELECT *, row_number() OVER (PARTITION BY ahu_id ORDER BY start_s DESC) AS rn FROM tx) WHERE rn <= 40"""
)
def q63_windows_latest(spark, sf):
    return live.windows_latest(_text_of_windows(spark, sf), 40)


_failed = "coalesce(nullif(array_to_string(rl, ','), ''), '')"


@query(
    f"""WITH {_SUMM} SELECT window_id, t0 AS start_ts, t1 AS end_ts, max_severity AS severity, text AS diagnosis,
    NULL::DOUBLE AS confidence, ahu_id, signature, {_failed} AS failed, 0 AS passed FROM tx"""
)
def q64_window_detail(spark, sf):
    d = live.window_detail(_text_of_windows(spark, sf))
    rules = [F.array_join("rules.failed.rule_id", ",").alias("failed"), F.size("rules.passed").alias("passed")]
    return d.select(
        "window_id", "start_ts", "end_ts", "severity", "diagnosis", "confidence", "summary.ahu_id", "summary.signature", *rules
    )


_QUIET = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


@query(
    f"""WITH {_SUMM} SELECT window_id, t0 AS start, t1 AS "end", max_severity
    FROM (SELECT *, row_number() OVER (PARTITION BY ahu_id ORDER BY start_s DESC) AS rn
FROM summ WHERE signature = '{_QUIET}') WHERE rn <= 50"""
)
def q65_incident_windows(spark, sf):
    d = live.incident_windows(_text_of_windows(spark, sf), _QUIET)
    return d.select("window_id", "start", "end", "max_severity")


@query(
    f"""WITH {_SUMM} SELECT 'ok' AS status, (SELECT {base._iso('max(ts_s)')} FROM tel) AS last_ts, (SELECT count(*)
    FROM tel) AS points_cached_total, max(t1) AS last_window_end,
  count(*) AS windows_cached_total, (SELECT string_agg(DISTINCT ahu_id, ',' ORDER BY ahu_id) FROM tel) AS ahus
  FROM summ"""
)
def q66_health(spark, sf):
    d = live.health(telemetry(spark, sf), _text_of_windows(spark, sf))
    return d.withColumn("ahus", F.array_join("ahus", ","))


@query(
    f"WITH {TELEMETRY_SQL} SELECT {_iso_ts} AS ts, sa_temp, cc_valve FROM tel "
    f"WHERE ahu_id = '3' AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-09 12:00:00'"
)
def q67_time_range(spark, sf):
    return live.time_range(
        telemetry(spark, sf), "ahu_id", "3", "timestamp", "2024-01-05", "2024-01-09 12:00:00", ["sa_temp", "cc_valve"]
    )


@query(
    f"""WITH {base.SUMM_SQL} SELECT window_id, ahu_id FROM summ WHERE t1 >= '2024-01-14T22:00:00Z'"""
)
def q68_windows_in_last(spark, sf):
    return live.windows_in_last(_text_of_windows(spark, sf), 10_000, AS_OF).select("window_id", "ahu_id")


@query(
    f"""WITH {base.SUMM_SQL}, a AS (SELECT window_id, ahu_id, start_s AS arrival FROM summ
    UNION ALL SELECT window_id, ahu_id, start_s + 1000000 FROM summ WHERE start_s % 5 = 0),
o AS (SELECT window_id, ahu_id, max(arrival) AS arrival FROM a GROUP BY 1, 2) SELECT *
  FROM (SELECT *, row_number() OVER (PARTITION BY ahu_id ORDER BY arrival DESC) AS rn FROM o) WHERE rn <= 60"""
)
def q69_ring_buffer(spark, sf):
    s = _text_of_windows(spark, sf).select(
        "window_id", "ahu_id", F.unix_timestamp(F.to_timestamp("time.start")).alias("arrival")
    )
    again = s.where("arrival % 5 = 0").withColumn("arrival", F.col("arrival") + 1_000_000)
    kept = live.ring_buffer(s.unionByName(again), "arrival", 60)
    rank = F.row_number().over(Window.partitionBy("ahu_id").orderBy(F.desc("arrival"))).cast("long")
    return kept.withColumn("rn", rank)


# --- diagnosis


def _unit_windows(spark, sf: str) -> DataFrame:
    """Each unit's last eight windows as an array, oldest first; units of odd numbers have no summary text."""
    s = _text_of_windows(spark, sf)
    s = s.withColumn("text_summary", F.when(F.col("ahu_id").cast("int") % 2 == 0, F.col("text_summary")))
    last = live.last_n(s.withColumn("__t", F.col("time.end")), "ahu_id", ["__t"], diagnosis.PROMPT_WINDOWS)
    w = F.struct(F.col("__t").alias("t"), "window_id", "time", "signature", "anomalies", "text_summary")
    return last.groupBy("ahu_id").agg(F.array_sort(F.collect_list(w)).alias("windows"))


_said = "CASE r " + " ".join(f"WHEN '{k}' THEN '{r.message}'" for k, r in base.CFG.rules.items()) + " END"
_LAST = f"""{_SUMM}, l AS (SELECT *, row_number() OVER (PARTITION BY ahu_id ORDER BY start_s DESC) AS rn FROM tx),
u AS (SELECT ahu_id, string_agg(window_id, ',' ORDER BY start_s) AS ids, min(t0) AS t0, max(t1) AS t1, max(CASE
  WHEN rn = 1 THEN text END) AS newest,
  coalesce(flatten(list(list_transform(rl, lambda r: {_said}) ORDER BY start_s) FILTER (WHERE rn <= 2)), []) AS said,
  flatten(list(rl)) AS rules FROM l WHERE rn <= 8 GROUP BY 1),
sy AS (SELECT *, CASE WHEN ahu_id::INT % 2 = 0 THEN newest ELSE array_to_string(said, '; ')[1:300] END AS symptoms
  FROM u),
rk AS (SELECT ahu_id, r, count(*) AS c FROM (SELECT ahu_id, unnest(rules) AS r FROM u) GROUP BY 1, 2),
tr AS (SELECT ahu_id, string_agg(r, ', ' ORDER BY c DESC, r) AS top
  FROM (SELECT *, row_number() OVER (PARTITION BY ahu_id ORDER BY c DESC, r) AS n FROM rk) WHERE n <= 5 GROUP BY 1)"""


@query(
    f"""WITH {_LAST}, q AS (SELECT ahu_id, trim(array_to_string(list_filter(['fault_type=F' || ahu_id,
    coalesce('rules=' || top, ''), trim(symptoms)], lambda p: p <> ''), chr(10))) AS query
FROM sy LEFT JOIN tr USING (ahu_id)) SELECT ahu_id, query, query || chr(10)
  || 'procedure inspection steps checklist verify' AS procedural FROM q"""
)
def q70_retrieval_query(spark, sf):
    u = _unit_windows(spark, sf)
    ids = u.select("ahu_id", F.flatten(F.transform("windows", lambda w: w["anomalies"]["rule_id"])).alias("ids"))
    top = live.top_rules(ids, ["ahu_id"], "ids", 5, alphabetical=True)
    d = u.join(top, "ahu_id", "left").withColumn("symptoms", diagnosis.symptom_summary(F.col("windows")))
    rules = F.coalesce("top_rules", F.array().cast("array<string>"))
    d = d.withColumn("query", diagnosis.retrieval_query(F.concat(F.lit("F"), "ahu_id"), F.col("symptoms"), rules))
    return d.select("ahu_id", "query", diagnosis.procedural(F.col("query")).alias("procedural"))


@query(
    f"""WITH {_LAST} SELECT ahu_id, ids AS evidence, t0 AS first_start, t1 AS last_end, symptoms,
    'doc_a,' || ids AS allowed FROM sy"""
)
def q71_prompt_context(spark, sf):
    u = _unit_windows(spark, sf)
    shown = diagnosis.windows_payload(F.col("windows"))
    span = diagnosis.overall_time_range(F.col("windows"))
    docs = F.array(F.lit("doc_a"), F.lit(""), F.lit("doc_a"))
    ids = F.transform(shown, lambda w: w["evidence_id"])
    d = u.select(
        "ahu_id", ids.alias("ids"), span.alias("span"), diagnosis.symptom_summary(
            F.col("windows")
        ).alias("symptoms"), docs.alias("docs")
    )
    allowed = diagnosis.allowed_evidence(F.col("ids"), F.col("docs"))
    order = F.concat(F.filter(allowed, lambda x: x == "doc_a"), F.filter(allowed, lambda x: x != "doc_a"))
    return d.select(
        "ahu_id",
        F.array_join("ids", ",").alias("evidence"),
        F.col("span.start").alias("first_start"),
        F.col("span.end").alias("last_end"),
        "symptoms",
        F.array_join(order, ",").alias("allowed"),
    )


_DOCS = """d AS (SELECT doc_id % 50 AS k, 'manuals' AS corpus, 'd' || doc_id AS doc_id, CASE
  WHEN doc_id % 3 = 0 THEN NULL ELSE (doc_id * 37 % 101) / 101.0::DOUBLE END AS distance, text, doc_id AS pos,
  CASE WHEN doc_id % 2 = 0 THEN 'm' || (doc_id % 7) END AS src, CASE
  WHEN doc_id % 5 = 0 THEN doc_id::VARCHAR END AS page FROM documents)"""


@query(
    f"""WITH {_DOCS}, r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY coalesce(distance, 1e9), pos) AS rank
    FROM d)
SELECT k, rank::INT AS rank, corpus, coalesce(src, r.doc_id) AS doc_id, r.doc_id AS chunk_id,
  'lang ' || lang AS source, 'general_section' AS chunk_type, page::INT AS page_start, NULL::INT AS page_end,
  distance AS score,
  md5(CASE WHEN length(coalesce(r.text, '')) > 1400 THEN r.text[1:1400] || '…' ELSE coalesce(r.text, '') END) AS text
  FROM r JOIN documents o ON 'd' || o.doc_id = r.doc_id WHERE rank <= 12"""
)
def q72_docs_payload(spark, sf):
    d = read(spark, sf, "documents")
    far = F.expr("CASE WHEN doc_id % 3 = 0 THEN NULL ELSE (doc_id * 37 % 101) / 101.0D END")
    meta = F.map_filter(
        F.create_map(
            F.lit("source_doc_id"), F.expr("CASE WHEN doc_id % 2 = 0 THEN concat('m', doc_id % 7) END"),
            F.lit("title"), F.concat(F.lit("lang "), "lang"),
            F.lit("chunk_type"), F.lit("general_section"),
            F.lit("page_start"), F.expr("CASE WHEN doc_id % 5 = 0 THEN CAST(doc_id AS STRING) END"),
        ),
        lambda _, v: v.isNotNull(),
    )
    docs = d.select(
        F.expr("doc_id % 50").alias("k"), F.lit("manuals").alias("corpus"), F.concat(
            F.lit("d"), "doc_id"
        ).alias("doc_id"), far.alias("distance"), "text", F.col("doc_id").alias("pos"), meta.alias("metadata")
    )
    return diagnosis.docs_payload(docs, "k").withColumn("text", F.md5("text"))


_REPLIES = {
    0: """{"title": "T%k", "root_cause": "c", "confidence": 1.5, "recommended_actions": " do it ", "evidence_ids": ["a", "x"]}""",
    1: """Sure. {"title": "T%k", "root_cause": "{r}", "confidence": "0.4", "conflict": true, "recommended_actions": ["x", "", " y "], "evidence_ids": ["x_1", "a"]} and more {""",
    2: "no object here",
    3: "[1, 2]",
    4: """{"title": "Truncated", "root_cause": "r", "confidence": 0.5}""",
    5: "",
    6: """{"title": "T%k", "root_cause": "r"}""",
}
_case = " ".join(f"WHEN {i} THEN replace('{r}', '%k', o_orderkey::VARCHAR)" for i, r in _REPLIES.items())
_ok = "o_orderkey % 7 < 2"


@query(
    f"""SELECT o_orderkey, CASE WHEN {_ok} THEN 'T' || o_orderkey ELSE 'Uncertain diagnosis' END AS title,
  CASE o_orderkey % 7 WHEN 0 THEN 'c' WHEN 1 THEN '{{r}}'
  ELSE 'Could not produce a grounded schema-valid diagnosis. (evidence: none) (reason: ' || CASE o_orderkey % 7
  WHEN 5 THEN 'empty' ELSE 'invalid' END || ' reply)' END AS root_cause,
  CASE o_orderkey % 7 WHEN 0 THEN 1.0 WHEN 1 THEN 0.4 ELSE 0.2 END::DOUBLE AS confidence, CASE o_orderkey % 7
  WHEN 0 THEN 'do it' WHEN 1 THEN 'x,y' ELSE 'Collect additional evidence and rerun diagnosis' END AS actions,
  CASE o_orderkey % 7 WHEN 0 THEN 'a' WHEN 1 THEN 'x_1,a' ELSE 'x_1,window:2' END AS evidence,
  o_orderkey % 7 <> 0 AS conflict FROM orders"""
)
def q73_parse_replies(spark, sf):
    o = read(spark, sf, "orders")
    reply = F.lit(None).cast("string")
    for i, r in _REPLIES.items():
        reply = F.when(
            F.col("o_orderkey") % 7 == i, F.replace(F.lit(r), F.lit("%k"), F.col("o_orderkey").cast("string"))
        ).otherwise(reply)
    allowed = F.array(*map(F.lit, ("a", "x_1", "window:2", "b")))
    d = diagnosis.replies_to_results(o.select("o_orderkey", reply.alias("reply"), allowed.alias("allowed")))
    lists = [
        F.array_join("recommended_actions", ",").alias("actions"), F.array_join("evidence_ids", ",").alias("evidence")
    ]
    return d.select("o_orderkey", "title", "root_cause", "confidence", *lists, "conflict")


@query(
    "SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN 1.5 WHEN 1 THEN 0.4 "
    "WHEN 4 THEN 0.5 END::DOUBLE AS confidence, o_orderkey % 7 IN (0, 1, 4, 6) AS found FROM orders"
)
def q74_first_json(spark, sf):
    o = read(spark, sf, "orders")
    reply = F.lit(None).cast("string")
    for i, r in _REPLIES.items():
        reply = F.when(F.col("o_orderkey") % 7 == i, F.lit(r)).otherwise(reply)
    d = o.select("o_orderkey", S.first_json_object(reply).alias("j"))
    return d.select(
        "o_orderkey",
        F.get_json_object("j", "$.confidence").cast("double").alias("confidence"),
        F.col("j").isNotNull().alias("found"),
    )


_HAS, _BUSY = "ahu_id IN ('1', '3')", "i % 5 = 0"
_FLAGGED = f"""{base._STREAK}, v AS (SELECT *, CASE WHEN s AND (rl2 >= 2 OR {_HAS}) THEN 'S'
  WHEN NOT s AND rl2 >= 3 AND NOT ({_BUSY}) THEN 'C' END AS evt FROM st),
w AS (SELECT *, coalesce(last_value(evt IGNORE NULLS) OVER (PARTITION BY ahu_id,
  fault ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'C') AS pe,
  coalesce(last_value(evt IGNORE NULLS) OVER (PARTITION BY ahu_id,
  fault ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'C') AS ce FROM v),
x AS (SELECT *, coalesce(evt = 'S' AND pe = 'C', false) AS opened, coalesce(evt = 'C' AND pe = 'S', false) AS resolved
  FROM w),
y AS (SELECT *, sum(opened::INT) OVER (PARTITION BY ahu_id, fault ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING
  AND CURRENT ROW) AS episode FROM x)"""


def _guarded(spark, sf: str) -> DataFrame:
    d = incidents.streaks(base._present(spark, sf))
    return d.withColumns(
        {
            "has_ticket": F.expr(_HAS),
            "busy": F.expr(_BUSY),
            "diagnosis_status": F.expr("CASE WHEN i % 4 = 0 THEN 'DIAGNOSED' ELSE 'DRAFT' END"),
        }
    )


@query(
    f"WITH {_FLAGGED} SELECT ahu_id, fault, episode::BIGINT AS episode, "
    f"min(i) FILTER (WHERE opened) AS opened_at, min(i) FILTER (WHERE resolved) AS resolved_at, "
    f"count(*) FILTER (WHERE s AND ce = 'S') AS occurrence_count FROM y WHERE episode > 0 GROUP BY 1, 2, 3"
)
def q75_guarded_episodes(spark, sf):
    e = incidents.episodes(_guarded(spark, sf))
    at = [F.col(c).cast("long").alias(c) for c in ("opened_at", "resolved_at")]
    return e.select("ahu_id", "fault", "episode", *at, "occurrence_count")


@query(f"WITH {_FLAGGED} SELECT ahu_id, fault, episode::BIGINT AS episode, i FROM y WHERE opened AND i % 4 <> 0")
def q76_diagnosis_triggers(spark, sf):
    return diagnosis.diagnosis_triggers(_guarded(spark, sf)).withColumn("i", F.col("i").cast("long"))


@query(f"WITH {base._STREAK} SELECT ahu_id, fault, i, CASE WHEN s THEN 'present' ELSE 'absent' END AS state FROM pr")
def q77_present_absent(spark, sf):
    s = _text_of_windows(spark, sf).select(
        "ahu_id",
        incidents.fault_types(F.col("anomalies")).alias("faults"),
        F.row_number().over(Window.partitionBy("ahu_id").orderBy("time.start")).alias("i"),
    )
    return incidents.recent_union(s).withColumn("i", F.col("i").cast("long"))


_tokens = "list_filter(list_transform({}, lambda x: trim(x)), lambda x: x <> '')"


@query(
    f"""WITH {base.SUMM_SQL}, h AS (SELECT window_id, list_transform(rl, lambda r: {base._hyp}) AS h FROM summ)
SELECT window_id, array_to_string(h, ',') AS a, array_to_string(h, ',') AS t, array_to_string(h, ',') AS m FROM h"""
)
def q78_hypothesis_forms(spark, sf):
    """The same hypotheses as a list with blanks, as comma-separated text and as the keys of maps."""
    s = _text_of_windows(spark, sf).select("window_id", F.flatten("anomalies.fault_hypotheses").alias("h"))
    blanks = F.concat(
        F.transform("h", lambda x: F.concat(F.lit(" "), x)), F.array(F.lit(" "), F.lit(None).cast("string"))
    )
    text = F.concat(F.lit(" ,"), F.array_join("h", " , "))
    maps = F.transform("h", lambda x: F.create_map(x, F.lit(0.5)))
    d = s.select("window_id", blanks.alias("a"), text.alias("t"), maps.alias("m"))
    names = {c: retrieval.hypothesis_tokens(F.col(c), d.schema[c].dataType) for c in ("a", "t", "m")}
    return d.select("window_id", *[F.array_join(x, ",").alias(c) for c, x in names.items()])


@query(
    f"""WITH {base.SUMM_SQL}, h AS (SELECT window_id, start_s // {base.SIZE} % 5 AS form,
  list_transform(rl, lambda r: {base._hyp}) AS h FROM summ)
SELECT window_id, form, CASE form WHEN 3 THEN array_to_string(list_sort(list_distinct(h)), ',') WHEN 4 THEN ''
  ELSE array_to_string(h, ',') END AS names FROM h"""
)
def q100_mixed_hypotheses(spark, sf):
    """One VARIANT column whose rows are lists of texts, comma-separated text, lists of maps, maps and numbers."""
    s = _text_of_windows(spark, sf).select(
        "window_id",
        F.expr(f"unix_timestamp(to_timestamp(time.start)) DIV {base.SIZE} % 5").alias("form"),
        F.flatten("anomalies.fault_hypotheses").alias("h"),
    )
    scored = F.map_from_arrays(F.array_distinct("h"), F.transform(F.array_distinct("h"), lambda _: F.lit(0.5)))
    text = (
        F.when(F.col("form") == 0, F.to_json("h"))
        .when(F.col("form") == 1, F.to_json(F.array(F.array_join("h", " , "))).substr(F.lit(2), F.lit(1 << 30)))
        .when(F.col("form") == 2, F.to_json(F.transform("h", lambda x: F.create_map(x, F.lit(1)))))
        .when(F.col("form") == 3, F.to_json(scored))
        .otherwise("17")
    )
    text = F.when(F.col("form") == 1, F.regexp_replace(text, r"\]$", "")).otherwise(text)
    d = s.select("window_id", "form", F.parse_json(text).alias("v"))
    names = retrieval.hypothesis_tokens(F.col("v"), d.schema["v"].dataType)
    return d.select("window_id", "form", F.array_join(names, ",").alias("names"))


def _evidence_sql() -> str:
    """The figures of every rule as rows (rule, name, value, there), from the windows' features."""
    out = []
    for rule, r in base.CFG.rules.items():
        fields = [f.partition("=") for f in base.rules.EVIDENCE.get(rule, ())]
        n = len(base.CFG.signals)
        own = {"missing_ratio": f"missing_count / greatest(sample_count * {n}, 1)", "num_signals": f"{n}"}
        rows = [(f, own.get(f, f if not instead else f"coalesce({f}, {instead})"), "true") for f, _, instead in fields]
        if rule.startswith("SAT_NOT"):
            rows.append(("sa_temp_delta", "sa_temp_delta", "sa_temp_delta IS NOT NULL"))
        if rows:
            rows += [(f"thresholds.{k}", v, "true") for k, v in r.params.items()]
        else:
            for s, (_, low, high) in base.CFG.signals.items():
                for k, bad in (("min", f"{s}_min < {low}"), ("max", f"{s}_max > {high}")):
                    at = f"offenders.{s}_{k}"
                    rows += [(f"{at}.value", f"{s}_{k}", bad), (f"{at}.min", low, bad), (f"{at}.max", high, bad)]
        out += [f"('{rule}', '{name}', ({v})::DOUBLE, {there})" for name, v, there in rows]
    return ", ".join(out)


@query(
    f"""WITH {base.ANOM_SQL} SELECT ahu_id, start_s, t.rule_id, t.name, round(t.value + 1e-9, 6) AS value
FROM anom, LATERAL (SELECT * FROM (VALUES {_evidence_sql()}) AS v(rule_id, name, value, there)) AS t
WHERE there AND list_contains(rl, t.rule_id)"""
)
def q101_rule_evidence(spark, sf):
    a = base._anom(spark, sf).select("ahu_id", base._start(), F.explode("anomalies").alias("a"))
    d = base.rules.evidence_values(a, "ahu_id", "start_s")
    return d.withColumn("value", F.round(F.col("value") + 1e-9, 6))


# --- tickets

_JSON = {
    0: ("""["a","b"]""", """["x"]"""),
    1: ("", "plain text"),
    2: ("not json", """{"b": 1}"""),
    3: ("""{"a":1}""", " "),
    4: (" [1, 2]", "7"),
}


@query(
    """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'a,b' WHEN 4 THEN '1,2' ELSE '' END AS evidence_ids, CASE o_orderkey % 5 WHEN 0 THEN '["x"]' WHEN 1 THEN '"plain text"' WHEN 2 THEN '{"b":1}' WHEN 4 THEN '7' END AS recommended_actions FROM orders"""
)
def q79_ticket_api_rows(spark, sf):
    o = read(spark, sf, "orders")
    ids, actions = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, (a, b) in _JSON.items():
        ids = F.when(F.col("o_orderkey") % 5 == i, F.lit(a)).otherwise(ids)
        actions = F.when(F.col("o_orderkey") % 5 == i, F.lit(b)).otherwise(actions)
    d = tickets.api_rows(o.select("o_orderkey", ids.alias("evidence_ids"), actions.alias("recommended_actions")))
    return d.withColumn("evidence_ids", F.array_join("evidence_ids", ","))


@query(
    """WITH t AS (SELECT 't' || o_orderkey AS id FROM orders), w AS (SELECT id, n, 'TCK-' || upper(substr(sha1(id), 1,
    n)) AS ref FROM t, (VALUES (4), (5), (6), (7), (8), (9), (10), (11), (12), (16), (40)) v(n)),
f AS (SELECT ref, min(id) AS id, min(n) AS n FROM w GROUP BY ref HAVING count(*) = 1) SELECT id AS ticket_id,
  arg_min(ref, n) AS ticket_ref FROM f WHERE ref NOT IN (SELECT 'TCK-' || upper(substr(sha1('c' || c_custkey), 1, 4))
  FROM customer) GROUP BY 1"""
)
def q80_ticket_refs(spark, sf):
    new = read(spark, sf, "orders").select(F.concat(F.lit("t"), "o_orderkey").alias("ticket_id"))
    taken = read(spark, sf, "customer").select(S.ticket_ref(F.concat(F.lit("c"), "c_custkey")).alias("ticket_ref"))
    return tickets.references(new, taken)


@query(
    f"WITH {adapter.TICKETS_SQL} SELECT ticket_id, CASE WHEN ticket_id = 't7' THEN 'APPROVED' "
    f"ELSE review_status END AS review_status, CASE WHEN ticket_id = 't7' THEN 'seen' END AS review_notes, CASE "
    f"WHEN ticket_id = 't7' THEN '2025-02-02' ELSE updated_at END AS updated_at FROM tk"
)
def q81_ticket_review(spark, sf):
    t = tickets.review(adapter.tickets(spark, sf), "t7", "APPROVED", "seen", "2025-02-02")
    return t.select("ticket_id", "review_status", "review_notes", "updated_at")


@query(
    f"WITH {adapter.TICKETS_SQL} SELECT ticket_id, ticket_ref FROM tk WHERE ticket_ref = 'TCK-6' OR ticket_id = 't7'"
)
def q82_ticket_by_name(spark, sf):
    t = adapter.tickets(spark, sf)
    found = tickets.get_ticket(t, "TCK-6").unionByName(tickets.get_ticket(t, "t7"))
    return found.select("ticket_id", "ticket_ref")


_IDS = {
    0: "7_2024-01-01T00:00:00Z_2024-01-01T00:05:00Z_300s_tumbling",
    1: "Window:idx:3",
    2: "manual_a::chunk::4",
    3: "CASE_12",
    4: "note",
    5: "window:CASE::chunk::",
}
_kinds = {0: "window", 1: "window", 2: "chunk", 3: "case", 4: "other", 5: "window"}


@query(
    "SELECT o_orderkey, CASE o_orderkey % 6 "
    + " ".join(f"WHEN {i} THEN '{k}'" for i, k in _kinds.items())
    + f" END AS kind, CASE WHEN o_orderkey % 6 = 5 THEN 3 ELSE 1 END AS lists, CASE o_orderkey % 6 WHEN 0 THEN '{_IDS[0]}' WHEN 1 THEN '{_IDS[1]}' WHEN 5 THEN '{_IDS[5]}' ELSE '' END AS last_two FROM orders"
)
def q83_evidence_kinds(spark, sf):
    c = F.lit(None).cast("string")
    for i, name in _IDS.items():
        c = F.when(F.col("o_orderkey") % 6 == i, F.lit(name)).otherwise(c)
    d = read(spark, sf, "orders").select("o_orderkey", c.alias("id")).withColumn("ids", F.array("id", F.lit(""), "id"))
    lists = S.evidence_lists(F.col("ids"))
    n = sum((F.size(lists[k]) for k in ("windows", "chunks", "cases", "other")), F.lit(0))
    none = F.array().cast("array<string>")
    view = live.ticket_view(none, none, F.col("ids"), F.lit(None).cast("string"))
    return d.select(
        "o_orderkey",
        S.evidence_kind(F.col("id")).alias("kind"),
        n.alias("lists"),
        F.array_join(view["window_refs"], ",").alias("last_two"),
    )


@query(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'b,c' ELSE (o_orderkey - 1) || ',' || o_orderkey END AS refs, CASE WHEN o_orderkey % 2 = 0 THEN 'abcdef12' ELSE 's1,s2,s3' END AS signatures FROM orders"""
)
def q84_ticket_view(spark, sf):
    k = F.col("o_orderkey").cast("string")
    refs = F.when(
        F.col("o_orderkey") % 3 == 0, F.array(*map(F.lit, ("a", "b", "a", "c")))
    ).otherwise(F.array(F.lit(""), (F.col("o_orderkey") - 1).cast("string"), k))
    signed = F.when(F.col("o_orderkey") % 2 == 0, F.array(F.lit(""))).otherwise(
        F.array(*map(F.lit, ("s1", "s2", "s1", "s3", "s4")))
    )
    d = read(spark, sf, "orders").select("o_orderkey", refs.alias("r"), signed.alias("s"))
    view = live.ticket_view(F.col("r"), F.col("s"), F.array().cast("array<string>"), F.lit("x. Signature=abcdef12 y"))
    return d.select(
        "o_orderkey",
        F.array_join(view["window_refs"], ",").alias("refs"),
        F.array_join(view["signatures"], ",").alias("signatures"),
    )


# --- manuals and cases


@query(
    """SELECT 'c' || c_custkey AS id, 'CASE_ID: c' || c_custkey || chr(10) || 'FAULT: ' || c_mktsegment || chr(10)
    || 'TITLE: ' || coalesce(c_name, '') || chr(10) || 'SYMPTOMS: hot|cold' || chr(10)
  || 'WINDOW_PATTERN: persistence=' || c_custkey % 9 || ', severity=, notes=n' || chr(10) || 'ROOT_CAUSE: ' || chr(10)
  || 'VERIFICATION: ' || chr(10) || 'RESOLUTION: ' || chr(10) || 'EXPECTED_POST_FIX: ' || chr(10)
  || 'TAGS: ' || c_mktsegment AS text, c_mktsegment AS tags, 'past_case' AS source FROM customer"""
)
def q85_case_documents(spark, sf):
    c = read(spark, sf, "customer")
    pattern = F.struct(
        (F.col("c_custkey") % 9).alias("persistence_windows"),
        F.lit(None).cast("string").alias("severity"),
        F.lit("n").alias("trend_notes"),
    )
    cases = c.select(
        F.concat(F.lit("c"), "c_custkey").alias("case_id"),
        F.col("c_mktsegment").alias("fault_type"),
        F.col("c_name").alias("fault_title"),
        F.array(F.lit("hot"), F.lit("cold")).alias("symptoms"),
        pattern.alias("window_pattern"),
        F.array("c_mktsegment").alias("tags"),
        F.lit(None).cast("array<string>").alias("resolution_steps"),
    )
    d = retrieval.case_documents(cases)
    # the last line's value keeps no trailing blank
    return d.select("id", "text", F.col("metadata")["tags"].alias("tags"), F.col("metadata")["source"].alias("source"))


@query(
    """SELECT o_orderkey, greatest(300, least(2000, coalesce(try_cast(CASE o_orderkey % 4 WHEN 0 THEN NULL
    WHEN 1 THEN 'x' ELSE (o_orderkey % 2500)::VARCHAR END AS INT), 800))) AS size,
  greatest(0, least(greatest(300, least(2000, coalesce(try_cast(CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'x'
  ELSE (o_orderkey % 2500)::VARCHAR END AS INT), 800))) - 1,
  coalesce(try_cast(CASE o_orderkey % 3 WHEN 0 THEN NULL ELSE (o_orderkey % 700 - 50)::VARCHAR END AS INT),
  100))) AS "overlap" FROM orders"""
)
def q86_chunk_params(spark, sf):
    o = read(spark, sf, "orders")
    size = F.expr("CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'x' ELSE CAST(o_orderkey % 2500 AS STRING) END")
    over = F.expr("CASE o_orderkey % 3 WHEN 0 THEN NULL ELSE CAST(o_orderkey % 700 - 50 AS STRING) END")
    d = o.select("o_orderkey", size.alias("a"), over.alias("b"))
    s, v = manuals.bounded_chunk_params(F.col("a"), F.col("b"))
    return d.select("o_orderkey", s.alias("size"), v.alias("overlap"))


_flat = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"
_chunk_words, _stride = manuals.words_for(300), manuals.words_for(300) - manuals.words_for(100)


@query(
    f"""WITH l AS (SELECT doc_id, list_transform(string_split_regex(text, '\\n'), lambda x: {_flat.format('x')}) AS ls
    FROM documents), c AS (SELECT doc_id, array_to_string(ls, ' ') AS corpus FROM l),
w AS (SELECT doc_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS w
  FROM documents), n AS (SELECT *, unnest(generate_series(0, greatest(0,
  ceil((len(w) - {_chunk_words}) / {_stride}.0)::INT))) AS chunk_no FROM w WHERE len(w) > 0),
k AS (SELECT doc_id, chunk_no, array_to_string(w[chunk_no * {_stride} + 1 : chunk_no * {_stride} + {_chunk_words}],
  ' ') AS chunk FROM n)
SELECT doc_id, chunk_no::INT AS chunk_no, nullif(strpos(corpus, chunk), 0) - 1 AS start, nullif(strpos(corpus, chunk),
  0) - 1 + length(chunk) AS "end" FROM k JOIN c USING (doc_id)"""
)
def q87_chunk_positions(spark, sf):
    """Documents as manuals, their lines as pages."""
    d = read(spark, sf, "documents").select("doc_id", "text")
    pages = d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("page_no", "text"))
    chunks = manuals.word_chunks(d, "text", 300, 100)
    return manuals.chunk_positions(chunks, manuals.joined_pages(pages)).select("doc_id", "chunk_no", "start", "end")


_LINES = "pg AS (SELECT doc_id % 40 AS doc_id, doc_id AS page_no, text FROM documents), ln AS (SELECT doc_id, page_no, unnest(range(len(s))) AS line_no, trim(unnest(s)) AS line FROM (SELECT doc_id, page_no, string_split_regex(text, '\\r\\n|\\n|\\r') AS s FROM pg))"


@query(
    f"""WITH {_LINES}, np AS (SELECT doc_id, count(DISTINCT page_no) AS n FROM pg
    GROUP BY 1), rep AS (SELECT doc_id, line FROM ln JOIN np USING (doc_id) WHERE line <> '' AND length(line) <= 80
    GROUP BY doc_id, line, n HAVING count(DISTINCT page_no) / n >= 0.5),
k AS (SELECT doc_id, page_no, string_agg(line, chr(10) ORDER BY line_no) AS text FROM ln
  WHERE line <> '' AND NOT regexp_full_match(line, '\\d{{1,4}}') AND (doc_id, line) NOT IN (SELECT (doc_id, line)
  FROM rep) GROUP BY 1, 2)
SELECT pg.doc_id, pg.page_no, md5(coalesce(k.text, '')) AS text FROM pg LEFT JOIN k ON k.page_no = pg.page_no"""
)
def q88_clean_pages(spark, sf):
    """Documents as pages of forty manuals."""
    pages = read(spark, sf, "documents").select(
        (F.col("doc_id") % 40).alias("doc_id"), F.col("doc_id").alias("page_no"), "text"
    )
    return manuals.clean_pages(pages).withColumn("text", F.md5("text"))


_est = "floor(len(regexp_extract_all(text, '\\S+')) * 1.3::DOUBLE)::INT"
_h, _t = "lower(heading)", "lower(chunk)"
_size, _step = manuals.words_for(300), manuals.words_for(300) - manuals.words_for(100)
_any = lambda names: " OR ".join(f"contains({_h}, '{x}')" for x in names)


@query(
    f"""WITH {_SECT}, s AS (SELECT doc_id, section, coalesce(max(s) FILTER (WHERE h), '') AS heading, string_agg(s,
    chr(10) ORDER BY line_no) FILTER (WHERE NOT h) AS body FROM sc GROUP BY 1, 2
    HAVING count(*) FILTER (WHERE NOT h) > 0),
b AS (SELECT *, CASE WHEN heading <> '' THEN heading || chr(10) || body ELSE body END AS text
  FROM s), e AS (SELECT *, {_est} AS est, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS w
  FROM b),
c AS (SELECT doc_id, section, heading, 0 AS chunk_no, text AS chunk FROM e WHERE est <= 300 UNION ALL
  SELECT doc_id, section, heading, k, array_to_string(w[k * {_step} + 1 : k * {_step} + {_size}], ' ')
  FROM (SELECT *, unnest(generate_series(0, greatest(0, ceil((len(w) - {_size}) / {_step}.0)::INT))) AS k FROM e
  WHERE est > 300)),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY section, chunk_no) - 1 AS i FROM c
  WHERE len(regexp_extract_all(chunk, '\\S+')) >= 30)
SELECT doc_id || '::chunk::' || i AS id, doc_id, section::BIGINT AS section, chunk_no::INT AS chunk_no,
  md5(chunk) AS chunk,
  CASE WHEN contains({_h}, 'table of contents') OR trim({_h}) = 'contents' OR (contains({_h},
  'contents') AND len(list_filter(string_split_regex({_h}, '\\s+'), lambda w: w <> '')) <= 3) THEN 'toc'
  WHEN contains({_h}, 'fault') AND (contains({_h}, 'table') OR contains({_t}, 'table')) THEN 'fault_table'
  WHEN {_any(manuals.PROCEDURE_WORDS)} THEN 'procedure' WHEN {_any(manuals.CHECKLIST_WORDS)} THEN 'checklist'
  WHEN {_any(manuals.DEFINITION_WORDS)} THEN 'definition' WHEN {_any(manuals.EQUATION_WORDS)} THEN 'equation'
  WHEN {_any(manuals.EXAMPLE_WORDS)} THEN 'case_example'
  WHEN regexp_matches({_t}, '\\bprocedure\\b') AND regexp_matches({_t}, '\\bstep\\b') THEN 'procedure'
  ELSE 'general_section' END AS chunk_type FROM f"""
)
def q89_manual_chunks(spark, sf):
    c = manuals.manual_chunks(read(spark, sf, "documents").select("doc_id", "text"), 300, 100)
    return c.withColumn("chunk", F.md5("chunk"))


_bounded = "greatest(300, least(2000, 300 + 100 * (n_nationkey % 3)))"


@query(
    f"""WITH {_LINES}, np AS (SELECT doc_id, count(DISTINCT page_no) AS n FROM pg GROUP BY 1),
rep AS (SELECT doc_id, line FROM ln JOIN np USING (doc_id) WHERE line <> '' AND length(line) <= 80
  GROUP BY doc_id, line, n HAVING count(DISTINCT page_no) / n >= 0.5),
m AS (SELECT n_nationkey AS k, n_name, 'f' || n_nationkey || '.pdf' AS file_name, {_bounded} AS tokens,
        greatest(50, floor({_bounded} / 1.3)::INT) AS size, greatest(50, floor(100 / 1.3)::INT) AS over,
        n_regionkey FROM nation),
dl AS (SELECT m.*, page_no, line_no, trim(regexp_replace(replace(line, chr(160), ' '), '[ \\t]+', ' ', 'g')) AS s FROM ln
       JOIN m ON m.k = ln.doc_id WHERE line <> '' AND NOT regexp_full_match(line, '\\d{{1,4}}')
         AND (doc_id, line) NOT IN (SELECT (doc_id, line) FROM rep)),
hd AS (SELECT *, {_HEAD} AS h, len(regexp_extract_all(s, '\\S+')) AS n FROM dl WHERE s <> ''),
sc AS (SELECT *, sum(h::INT) OVER w AS section, bool_or(h) OVER (PARTITION BY k) AS headed FROM hd
       WINDOW w AS (PARTITION BY k ORDER BY page_no, line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
g AS (SELECT k, section, sum(n) AS total, coalesce(max(s) FILTER (WHERE h), '') AS heading,
        count(*) FILTER (WHERE NOT h) AS bodies FROM sc GROUP BY 1, 2),
pv AS (SELECT *, lag(page_no) OVER (PARTITION BY k, section ORDER BY page_no, line_no) AS before,
         lag(section) OVER (PARTITION BY k, section ORDER BY page_no, line_no) IS NULL AS first FROM sc),
c0 AS (SELECT pv.k, section, 0 AS chunk_no, any_value(heading) AS heading, any_value(total) AS words,
         string_agg(CASE WHEN first THEN '' WHEN NOT headed AND before <> page_no THEN chr(10) || chr(10) ELSE chr(10) END
           || s, '' ORDER BY page_no, line_no) AS chunk, min(page_no) AS page_start, max(page_no) AS page_end
       FROM pv JOIN g USING (k, section) WHERE bodies > 0 AND floor(total * 1.3::DOUBLE) <= tokens GROUP BY 1, 2),
wd AS (SELECT k, section, page_no, size, greatest(1, size - least(size - 1, over)) AS stride, total, heading, word,
         row_number() OVER (PARTITION BY k, section ORDER BY page_no, line_no, i) - 1 AS pos
       FROM (SELECT *, unnest(regexp_extract_all(s, '\\S+')) AS word, unnest(range(n)) AS i FROM sc) JOIN g USING (k, section)
       WHERE bodies > 0 AND floor(total * 1.3::DOUBLE) > tokens),
cw AS (SELECT *, unnest(range(greatest(0, ceil((pos - size + 1) / stride)::INT), least(greatest(0,
         ceil((total - size) / stride)::INT), pos // stride) + 1)) AS chunk_no FROM wd),
c1 AS (SELECT k, section, chunk_no, any_value(heading), count(*), string_agg(word, ' ' ORDER BY pos), min(page_no), max(page_no)
       FROM cw GROUP BY 1, 2, 3),
f AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY section, chunk_no) - 1 AS chunk_index
      FROM (SELECT * FROM c0 UNION ALL SELECT * FROM c1) WHERE words >= 30)
SELECT n_name || '::chunk::' || chunk_index AS id, md5(chunk) AS document, n_name AS doc_id, file_name,
  n_regionkey % 2 = 0 AS supports_diagnosis, 'r' || n_regionkey || '|' || n_name AS fault_types,
  CASE WHEN contains({_h}, 'table of contents') OR trim({_h}) = 'contents' OR (contains({_h},
  'contents') AND len(list_filter(string_split_regex({_h}, '\\s+'), lambda w: w <> '')) <= 3) THEN 'toc'
  WHEN contains({_h}, 'fault') AND (contains({_h}, 'table') OR contains({_t}, 'table')) THEN 'fault_table'
  WHEN {_any(manuals.PROCEDURE_WORDS)} THEN 'procedure' WHEN {_any(manuals.CHECKLIST_WORDS)} THEN 'checklist'
  WHEN {_any(manuals.DEFINITION_WORDS)} THEN 'definition' WHEN {_any(manuals.EQUATION_WORDS)} THEN 'equation'
  WHEN {_any(manuals.EXAMPLE_WORDS)} THEN 'case_example'
  WHEN regexp_matches({_t}, '\\bprocedure\\b') AND regexp_matches({_t}, '\\bstep\\b') THEN 'procedure'
  ELSE 'general_section' END AS chunk_type, page_start, page_end, 'manual' AS source
FROM f JOIN m ON m.k = f.k"""
)
def q102_manual_index(spark, sf):
    """Documents as pages of forty manuals, of which the nations describe twenty-five."""
    pages = read(spark, sf, "documents").select(
        F.concat(F.lit("f"), F.col("doc_id") % 40, F.lit(".pdf")).alias("file_name"), F.col("doc_id").alias("page_no"), "text"
    )
    metadata = read(spark, sf, "nation").selectExpr(
        "concat('f', n_nationkey, '.pdf') AS file_name",
        "n_name AS doc_id",
        "n_regionkey % 2 = 0 AS supports_diagnosis",
        "array(concat('r', n_regionkey), n_name) AS fault_types",
        "CAST(300 + 100 * (n_nationkey % 3) AS STRING) AS recommended_chunk_size_tokens",
        "'100' AS recommended_overlap_tokens",
    )
    shown = "doc_id file_name supports_diagnosis fault_types chunk_type page_start page_end source".split()
    return manuals.manual_index(pages, metadata).select(
        "id", F.md5("document").alias("document"), *(f"metadata.{c}" for c in shown)
    )


# --- intake


def _raw(spark, sf: str) -> DataFrame:
    """Telemetry as texts, some without time or unit."""
    t = telemetry(spark, sf)
    when = F.when(F.col("event_id") % 7 == 0, " ").otherwise(S.iso_z(F.col("timestamp")))
    unit = F.when(F.col("event_id") % 11 == 0, "").otherwise(F.col("ahu_id"))
    signals = [F.col(s).cast("string").alias(s) for s in base.CFG.signals]
    return t.select(F.col("event_id").alias("arrival"), when.alias("ts"), unit.alias("ahu_id"), *signals)


_all = " AND ".join(f"{s} IS NOT NULL" for s in base.CFG.signals)


@query(
    f"""WITH {TELEMETRY_SQL}, f AS (SELECT *, event_id % 7 <> 0 AS t, event_id % 11 <> 0 AS u, {_all} AS v FROM tel)
SELECT 'both' AS policy, count(*) FILTER (WHERE t AND u) AS n, sum(event_id) FILTER (WHERE t AND u)::BIGINT AS ids
  FROM f UNION ALL SELECT 'neither', count(*), sum(event_id)::BIGINT FROM f
UNION ALL SELECT 'time', count(*) FILTER (WHERE t), sum(event_id) FILTER (WHERE t)::BIGINT FROM f
  UNION ALL SELECT 'whole', count(*) FILTER (WHERE t AND u AND v), sum(event_id) FILTER (WHERE t AND u AND v)::BIGINT
  FROM f"""
)
def q90_missing_policies(spark, sf):
    raw, out = _raw(spark, sf), None
    for name, t, u, v in (
        ("both", True, True, True),
        ("neither", False, False, True),
        ("time", True, False, True),
        ("whole", True, True, False),
    ):
        cfg = Config(drop_if_missing_timestamp=t, drop_if_missing_unit=u, allow_missing_values=v)
        d = normalize.normalize_events(raw, cfg).agg(F.count("*").alias("n"), F.sum("arrival").alias("ids"))
        d = d.select(F.lit(name).alias("policy"), "n", "ids")
        out = d if out is None else out.unionByName(d)
    return out


@query(
    f"WITH {base.SUMM_SQL} SELECT window_id, ahu_id FROM summ WHERE start_s % 7 <> 0 AND start_s % 11 <> 0 "
    f"AND ahu_id <> '5'"
)
def q91_valid_windows(spark, sf):
    s = _text_of_windows(spark, sf).withColumn("k", F.unix_timestamp(F.to_timestamp("time.start")))
    broken = s.withColumn("signature", F.when(F.col("k") % 7 == 0, "").otherwise(F.col("signature")))
    start = F.when(F.col("k") % 11 == 0, "no time").otherwise(F.col("time.start"))
    broken = broken.withColumn("time", F.struct(start.alias("start"), F.col("time.end").alias("end")))
    broken = broken.withColumn("ahu_id", F.nullif("ahu_id", F.lit("5")))
    return normalize.normalize_windows(broken).select("window_id", "ahu_id")


@query(
    f"WITH {TELEMETRY_SQL} SELECT count(*) AS consumed, count(*) FILTER (WHERE event_id % 7 <> 0) AS indexed, "
    f"count(*) FILTER (WHERE event_id % 7 = 0) AS skipped FROM tel"
)
def q92_intake_counters(spark, sf):
    rows, seen = normalize.counted(_raw(spark, sf), F.trim("ts") != "")
    rows.write.format("noop").mode("overwrite").save()
    got = seen.get
    return spark.createDataFrame(
        [tuple(got[k] for k in ("consumed", "indexed", "skipped"))], "consumed long, indexed long, skipped long"
    )


@query(
    f"WITH {TELEMETRY_SQL} SELECT event_id, round((epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY ahu_id "
    f"ORDER BY ts, event_id)) / 1e6::DOUBLE, 6) AS gap_s, round((epoch_us(ts) - (SELECT min(epoch_us(ts)) "
    f"FROM tel)) / 1e6::DOUBLE * 2, 6) AS due_s, {base._iso('ts_s + 3600')} AS later FROM tel"
)
def q93_gaps_and_replay(spark, sf):
    t = ordering.replay_schedule(ordering.gaps(telemetry(spark, sf), ties=("event_id",)), 0.5)
    moved = gating.shift(t.withColumn("later", F.col("timestamp")), 3600, "later")
    return moved.select(
        "event_id",
        F.round("gap_s", 6).alias("gap_s"),
        F.round("due_s", 6).alias("due_s"),
        S.iso_z(F.col("later")).alias("later"),
    )


@query(
    f"WITH {TELEMETRY_SQL}, f AS (SELECT *, min(ts_s) OVER (PARTITION BY ahu_id) AS f "
    f"FROM tel) SELECT ahu_id, ts_s - (ts_s - f) % 21600 AS start_s, count(*) AS n FROM f GROUP BY 1, 2"
)
def q94_unaligned_windows(spark, sf):
    d = windows.unaligned_start(telemetry(spark, sf), SIZE)
    return d.groupBy("ahu_id", F.unix_timestamp("start").alias("start_s")).agg(F.count("*").alias("n"))


_cols = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) AS rows, count(*) - count({c}) AS nulls FROM orders" for c in _cols
    )
)
def q95_inspect_parquet(spark, sf):
    d = readers.inspect_parquet(spark, f"{sf}/orders.parquet")
    return d.where(F.col("column").isin(*_cols)).select("column", "rows", "nulls")


@query(
    """SELECT doc_id, CASE WHEN length(t) > 80 THEN t[1:77] || '...'
    ELSE t END AS short, sha1(doc_id || '||' || coalesce(lang, '') || '||') AS fallback, least(1, greatest(0, CASE
    WHEN p > 1 THEN p / 100 ELSE p END))::DOUBLE AS share
FROM (SELECT doc_id, lang, trim(replace(coalesce(text, ''), chr(10), ' ')) AS t, (doc_id % 130 - 5)::DOUBLE AS p
  FROM documents)"""
)
def q96_text_forms(spark, sf):
    d = read(spark, sf, "documents").select(
        "doc_id",
        S.compact_text(F.col("text"), 80).alias("short"),
        F.col("doc_id").cast("string").alias("ahu_id"),
        F.lit(" ").alias("window_id"),
        F.struct(F.col("lang").alias("start"), F.lit("").alias("end")).alias("time"),
        F.lit("").alias("signature"),
        S.fraction((F.col("doc_id") % 130 - 5).cast("double")).alias("share"),
    )
    d = d.withColumn("window_id", F.lit(""))
    return d.select("doc_id", "short", retrieval.history_id(d).alias("fallback"), "share")


@query(
    f"WITH {TELEMETRY_SQL} SELECT event_id, "
    f"{base._iso('max(ts_s) OVER (PARTITION BY ahu_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 5')} AS watermark "
    f"FROM tel"
)
def q97_running_watermark(spark, sf):
    d = ordering.running_watermark(telemetry(spark, sf), "ahu_id", "timestamp", "event_id", 5)
    return d.select("event_id", S.iso_z(F.col("watermark")).alias("watermark"))


_rt = "nullif(list_aggregate(list_filter([{}], lambda x: x IS NOT NULL), 'string_agg', ', '), '')"
_shown = ", ".join(
    f"CASE WHEN {n} IS NOT NULL THEN '{labels.FEATURE_LABELS[n][0]}=' || printf('%.2f', printf('%.{d}f', "
    f"{n})::DOUBLE) || ' {labels.FEATURE_LABELS[n][1]}' END"
    for n, d in (("sa_temp_mean", 2), ("sa_temp_mean_minus_sp", 2), ("cc_valve_mean", 1), ("avg_zone_temp_mean", 2))
)


@query(
    f"""WITH {_SUMM} SELECT window_id, coalesce({_rt.format(_shown)}, '') AS features, t0 || '–' || t1 AS "window",
    array_to_string(list_sort(rl), ',') AS anomalies, '6 hours' AS duration, 'AHU ' || ahu_id AS unit,
  CASE WHEN array_to_string(list_sort(rl), ',') = '' THEN 'none' ELSE array_to_string(list_sort(rl), ',') END AS field
  FROM tx"""
)
def q98_window_labels(spark, sf):
    s = _text_of_windows(spark, sf).withColumn("k", labels.key_symptoms(F.col("text_summary")))
    entries = F.transform(
        F.map_entries(labels.feature_labels(F.col("text_summary"))),
        lambda e: F.concat(e["key"], F.lit("="), e["value"]),
    )
    return s.select(
        "window_id",
        F.array_join(entries, ", ").alias("features"),
        F.col("k.window").alias("window"),
        F.array_join(F.array_remove("k.anomalies", "none"), ",").alias("anomalies"),
        labels.duration_label(F.to_timestamp("time.start"), F.to_timestamp("time.end")).alias("duration"),
        labels.unit_label(F.col("ahu_id")).alias("unit"),
        labels.field(F.col("text_summary"), "anomalies=").alias("field"),
    )


@query(
    f"""WITH {adapter.TICKETS_SQL} SELECT ticket_id, CASE detected_fault_type WHEN '1-URGENT' THEN '1-urgent'
    WHEN '2-HIGH' THEN '2-high' WHEN '3-MEDIUM' THEN '3-medium' WHEN '4-NOT SPECIFIED' THEN '4-not Specified'
    WHEN '5-LOW' THEN '5-low' END AS fault,
  CASE WHEN ticket_id LIKE '%5' THEN '—' WHEN ticket_id LIKE '%6' THEN 'AHU 12' WHEN ticket_id LIKE '%7' THEN 'roof'
  ELSE 'AHU ' || ahu_id END AS unit, greatest(0, least(100, floor(coalesce(confidence, 0) * 100 + 0.5)))::INT AS pct,
  coalesce(diagnosis_title, '') AS "primary", CASE WHEN diagnosis_title IS NULL THEN ''
  ELSE 'Reasoning: x' END AS reasoning,
  CASE WHEN occurrence_count = 0 THEN '—' WHEN occurrence_count < 3 THEN occurrence_count * 25 || ' minutes'
  ELSE trim(trim(printf('%.1f', floor(occurrence_count * 25 / 6.0 + 0.5) / 10), '0'), '.') || ' hours' END AS duration
  FROM tk"""
)
def q99_ticket_labels(spark, sf):
    t = adapter.tickets(spark, sf)
    odd = F.when(F.col("ticket_id").endswith("5"), " ").when(F.col("ticket_id").endswith("6"), "ahu12")
    unit = odd.when(F.col("ticket_id").endswith("7"), "roof").otherwise(F.col("ahu_id"))
    title = F.col("diagnosis_title")
    cause = F.when(title.isNull(), "").otherwise(F.concat(title, F.lit(" \nReasoning: x ")))
    cause = labels.root_cause_parts(F.regexp_replace(cause, "\n", " "))
    start = F.lit("2025-01-01").cast("timestamp")
    end = F.timestamp_seconds(F.unix_timestamp(start) + F.col("occurrence_count") * 1500)
    return t.select(
        "ticket_id",
        labels.fault_label(F.col("detected_fault_type")).alias("fault"),
        labels.unit_label(unit).alias("unit"),
        labels.percent(F.col("confidence")).alias("pct"),
        cause["primary"].alias("primary"),
        cause["reasoning"].alias("reasoning"),
        labels.duration_label(start, end).alias("duration"),
    )
