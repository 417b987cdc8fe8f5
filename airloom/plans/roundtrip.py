"""Sources and sinks: the driver's tables written and read again, held against SQL over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import live, manuals, normalize, retrieval
from ..sources import collections, readers, replay, sinks
from ..sources.adapter import TELEMETRY_SQL, TICKETS_SQL, read, telemetry, tickets
from ..staging import new_path
from ..streaming import state
from . import streams
from . import telemetry as base
from .text import _knn, _queries

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _text_time(c: str = "timestamp"):
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


_signals = list(base.CFG.signals)
_rounded = ", ".join(f"round({s} + 1e-9, 6) AS {s}" for s in _signals)


@query(f"WITH {TELEMETRY_SQL} SELECT ahu_id, epoch_us(ts) AS ts_us, {_rounded} FROM tel")
def q103_csv_round_trip(spark, sf) -> DataFrame:
    """Telemetry to CSV with its required columns, and read typed."""
    at = new_path(spark, "csv")
    rows = telemetry(spark, sf).withColumn("timestamp", _text_time())
    sinks.write_csv(rows, at, ["timestamp", "ahu_id", *_signals])
    typed = readers.csv_events(spark, at, ("timestamp", "ahu_id"), base.CFG)
    return typed.select("ahu_id", F.unix_micros("timestamp").alias("ts_us"), *[base._num(s) for s in _signals])


_there = " + ".join(f"({s} IS NOT NULL)::INT" for s in _signals)


@query(
    f"WITH {TELEMETRY_SQL} SELECT ahu_id, epoch_us(ts) AS ts_us, {_there} AS n, round(sa_temp + 1e-9, 6) AS sa_temp, "
    f"round(oa_temp + 1e-9, 6) AS oa_temp FROM tel WHERE event_id % 5 <> 0"
)
def q104_json_intake(spark, sf) -> DataFrame:
    """Events as JSON lines, nested and flat, some without a unit or no objects at all, as the serving side takes them."""
    at = new_path(spark, "json")
    t = telemetry(spark, sf).withColumn("when", _text_time())
    nested = F.to_json(F.struct(F.col("when").alias("timestamp"), "ahu_id", F.struct(*_signals).alias("values")))
    flat = F.to_json(F.struct(F.lit(" ").alias("timestamp"), F.col("when").alias("ts"), "ahu_id", *_signals))
    lost = F.when(F.col("event_id") % 10 == 0, "[1, 2]").otherwise(
        F.to_json(F.struct(F.col("when").alias("ts"), F.lit("  ").alias("ahu_id"), *_signals))
    )
    line = F.when(F.col("event_id") % 5 == 0, lost).when(F.col("event_id") % 2 == 0, nested).otherwise(flat)
    t.select(line.alias("value")).write.text(at)
    rows = normalize.with_required(normalize.parse_json(spark.read.text(at)), "ahu_id", "timestamp")
    return normalize.free_form_values(rows).select(
        "ahu_id",
        F.unix_micros(F.to_timestamp("timestamp")).alias("ts_us"),
        F.size("values").alias("n"),
        *[F.round(F.col("values")[s] + 1e-9, 6).alias(s) for s in ("sa_temp", "oa_temp")],
    )


@query(
    f"WITH {base.SUMM_SQL} SELECT window_id, ahu_id, t0 AS start, signature, sample_count, missing_count, "
    f"array_to_string(rl, ',') AS rules, round(oa_temp_mean + 1e-9, 6) AS oa_temp_mean FROM summ"
)
def q105_summary_lines(spark, sf) -> DataFrame:
    at = new_path(spark, "lines")
    sinks.write_jsonl(base._summ(spark, sf), at)
    d = readers.jsonl_summaries(spark, at)
    return d.select(
        "window_id",
        "ahu_id",
        F.col("time.start").alias("start"),
        "signature",
        "stats.sample_count",
        "stats.missing_count",
        base._rules(),
        F.round(F.col("features")["oa_temp_mean"] + 1e-9, 6).alias("oa_temp_mean"),
    )


@query(
    f"""WITH {base.SUMM_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY ahu_id ORDER BY start_s DESC) AS n FROM summ)
SELECT ahu_id, window_id, signature FROM n WHERE n <= 3"""
)
def q106_last_summaries(spark, sf) -> DataFrame:
    """The last three lines of each unit, where every line is followed by one that is none."""
    at = new_path(spark, "lines")
    lines = sinks.json_lines(base._summ(spark, sf).orderBy("ahu_id", "time.start"))
    lines.select(F.concat("value", F.lit('\n{"broken": ')).alias("value")).write.text(at)
    return readers.last_summaries(spark, at, 3).select("ahu_id", "window_id", "signature")


@query(
    f"""WITH {base.SUMM_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY ahu_id ORDER BY start_s DESC) AS n FROM summ)
SELECT window_id, CASE WHEN max_severity >= 2 THEN 'second' ELSE 'first' END AS written, n <= 5 AS recent FROM n"""
)
def q107_collections(spark, sf) -> DataFrame:
    """Two batches, each given to a collection of all windows and to a store that retains each unit's newest five."""
    kept, recent = new_path(spark, "windows"), new_path(spark, "recent")
    s = base._summ(spark, sf).select(
        "window_id", "ahu_id", "signature", F.unix_timestamp(F.to_timestamp("time.start")).alias("arrival"),
        live.max_severity(F.col("anomalies")).alias("severity"),
    )
    write = sinks.tee(collections.collection_writer(kept, "window_id"), collections.window_store(recent, "arrival", 5))
    write(s.withColumn("written", F.lit("first")), 0)
    write(s.where("severity >= 2").withColumn("written", F.lit("second")), 1)
    newest = collections.read_collection(spark, recent).select("window_id", F.lit(True).alias("recent"))
    both = collections.read_collection(spark, kept).join(newest, "window_id", "left")
    return both.select("window_id", "written", F.coalesce("recent", F.lit(False)).alias("recent"))


@query(
    """SELECT 'f' || n_nationkey || '.pdf' AS file_name, n_name AS doc_id, 'r' || n_regionkey || ',' || n_name AS topics,
  (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS pages FROM nation
WHERE n_nationkey IN (SELECT s_nationkey FROM supplier)"""
)
def q108_manual_metadata(spark, sf) -> DataFrame:
    """Metadata as a JSON list and a manifest as CSV, both read again and joined by file name."""
    meta, listed = new_path(spark, "meta"), new_path(spark, "manifest")
    n = read(spark, sf, "nation").selectExpr("concat('f', n_nationkey, '.pdf') AS file_name", "n_name AS doc_id")
    n.agg(F.to_json(F.collect_list(F.struct("*"))).alias("value")).write.text(meta)  # one short list, as the file is
    names = read(spark, sf, "nation").selectExpr(
        "n_nationkey", "concat('f', n_nationkey, '.pdf') AS file_name", "concat('r', n_regionkey, '|', n_name) AS topics"
    )
    files = read(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("pages"))
    sinks.write_csv(names.join(files, "n_nationkey"), listed, ["file_name", "topics", "pages"])
    found = manuals.attach_metadata(readers.manifest(spark, listed, ("topics",)), readers.documents_metadata(spark, meta))
    return found.select("file_name", "doc_id", F.array_join("topics", ",").alias("topics"), F.col("pages").cast("long").alias("pages"))


@query(
    """SELECT 'C' || c_custkey AS id, md5('CASE_ID: C' || c_custkey || chr(10) || 'FAULT: ' || c_mktsegment) AS head,
  c_mktsegment AS fault_type FROM customer WHERE c_custkey % 5 <> 0"""
)
def q109_past_cases(spark, sf) -> DataFrame:
    """Past cases as JSON lines, some without an id, as searchable texts; ``head`` is their first two lines."""
    at = new_path(spark, "cases")
    c = read(spark, sf, "customer").selectExpr(
        "CASE c_custkey % 10 WHEN 0 THEN NULL WHEN 5 THEN ' ' ELSE concat('C', c_custkey) END AS case_id",
        "c_mktsegment AS fault_type",
        "array('hot', c_mktsegment) AS symptoms",
    )
    c.select(F.to_json(F.struct("*"))).write.text(at)
    d = retrieval.case_documents(readers.past_cases(spark, at))
    head = F.substring_index("text", "\n", 2)
    return d.select("id", F.md5(head).alias("head"), F.col("metadata")["fault_type"].alias("fault_type"))


@query(f"WITH {base.SUMM_SQL} SELECT window_id, signature FROM summ WHERE start_s // {base.SIZE} % 7 = 0")
def q110_window_lookup(spark, sf) -> DataFrame:
    """Windows in buckets, looked up by ids, of which some are unknown: a bucket meets only its own ids."""
    at = new_path(spark, "windows")
    s = base._summ(spark, sf).select("window_id", "signature", F.unix_timestamp(F.to_timestamp("time.start")).alias("at"))
    collections.collection_writer(at, "window_id")(s, 0)
    asked = s.where(F.expr(f"at DIV {base.SIZE} % 7 = 0")).select("window_id")
    unknown = s.select(F.concat("window_id", F.lit("?")).alias("window_id"))
    return collections.find_all(spark, at, "window_id", asked.unionByName(unknown)).select("window_id", "signature")


@query(
    f"""WITH {_knn('true', 8)}, c AS (SELECT query_id, CASE WHEN label < 5 THEN 'manuals' ELSE 'past_cases' END AS corpus,
  vec_id, distance, rank FROM h), n AS (SELECT *, row_number() OVER (PARTITION BY query_id, corpus ORDER BY rank) AS n FROM c)
SELECT query_id::INT AS query, 'FAULT_' || query_id AS fault_type, corpus, n::INT AS rank, 'D' || vec_id AS doc_id,
  round(distance, 4) AS distance, 'v' || vec_id AS file, 'first line of ' || vec_id || ' second = line' AS text FROM n WHERE n <= 3"""
)
def q111_retrieval_log(spark, sf) -> DataFrame:
    """Nearest neighbours written as a retrieval log, a section for each query, and parsed again."""
    at = new_path(spark, "log")
    hits = retrieval.knn(read(spark, sf, "embeddings"), _queries(spark, sf), 8)
    heading = F.when(F.col("label") < 5, "  Manuals (Top 3)").otherwise("  Past Cases (Top 3)")
    entry = F.format_string(
        "\n    #%s  id=D%s\n        distance=%.4f  score=0.5\n        doc_id=D%s | file=v%s | note\n        snippet:\n"
        "        first line of %s\n      second = line\n",
        "rank", "vec_id", "distance", "vec_id", "vec_id", "vec_id",
    )
    per = hits.groupBy("query_id", heading.alias("heading")).agg(F.array_sort(F.collect_list(F.struct("rank", entry.alias("e")))).alias("es"))
    block = F.concat("heading", F.lit("\n"), F.array_join("es.e", ""))
    per = per.groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_list(block)), "\n").alias("body"))
    q = F.col("query_id").cast("string")
    text = F.concat(F.lit("Q"), q, F.lit(": fault_type=FAULT_"), q, F.lit("\nrules=A, B\n\n"), "body")
    per.select(text.alias("value")).write.text(at)
    return readers.retrieval_log(spark, at).select(
        *"query fault_type corpus rank doc_id distance".split(), F.col("metadata")["file"].alias("file"), "text"
    )


@query(
    f"WITH {TICKETS_SQL} SELECT ticket_id, lifecycle_status, CASE WHEN substr(ticket_id, 2)::BIGINT % 10 = 1 THEN 'REJECTED' "
    f"ELSE review_status END AS review_status, CASE WHEN substr(ticket_id, 2)::BIGINT % 10 = 1 THEN 'seen ' || ahu_id END "
    f"AS review_notes, CASE WHEN substr(ticket_id, 2)::BIGINT % 10 = 1 THEN '2026' ELSE updated_at END AS updated_at FROM tk"
)
def q113_review_batch(spark, sf) -> DataFrame:
    """Tickets in buckets, of which a table of reviews rewrites those it touches."""
    at = new_path(spark, "tickets")
    t = tickets(spark, sf)
    collections.collection_writer(at, "ticket_id")(t, 0)
    reviews = t.where("CAST(substr(ticket_id, 2) AS BIGINT) % 10 = 1").selectExpr(
        "ticket_id", "'REJECTED' AS review_status", "concat('seen ', ahu_id) AS review_notes"
    )
    collections.review_tickets(at, reviews, "2026")
    columns = "ticket_id lifecycle_status review_status review_notes updated_at".split()
    return collections.read_collection(spark, at).select(*columns)


@query(f"WITH {TELEMETRY_SQL} SELECT event_id, ahu_id, epoch_us(ts) AS ts_us FROM tel")
def st_replay(spark, sf) -> DataFrame:
    """The events replayed as fast as possible, five days of them a batch, until nothing more comes."""
    at, out = new_path(spark, "replay"), new_path(spark, "replayed")
    rows = telemetry(spark, sf).select("event_id", "ahu_id", "timestamp")
    replay.stage(rows, at)
    stream = replay.replay(spark, at, rows.schema, speed=0, max_seconds=5 * 86_400)
    q = stream.writeStream.format("parquet").option("checkpointLocation", f"{out}/state").start(f"{out}/out")
    replay.run_until_idle(q, 8.0)
    back = spark.read.schema(rows.schema).parquet(f"{out}/out")
    return back.select("event_id", "ahu_id", F.unix_micros("timestamp").alias("ts_us"))


_flushed = streams._ARRIVALS.replace("greatest(seq, fs) END", "greatest(seq, coalesce(fs, 1000000000000000000)) END").replace(
    " FROM r WHERE dup OR fs IS NOT NULL)", " FROM r)"
).replace(f"max(w), {base.SIZE}", f"max(w) + 1, {base.SIZE}")


@query(
    f"WITH {_flushed} SELECT unit, s.w AS window_s, coalesce(samples, 0) AS sample_count, coalesce(dups, 0) AS "
    f"duplicate_count, coalesce(lates, 0) AS late_count FROM s LEFT JOIN c USING (unit, w)"
)
def st_flushed_windows(spark, sf) -> DataFrame:
    """As ``st_unit_windows``, with the end of each unit's stream told by a row of its own, which flushes it."""
    d = streams._late_arrivals(spark, sf)
    ends = spark.readStream.schema(read(spark, sf, "nation").schema).parquet(f"{sf}/natio[n].parquet")
    ends = ends.where("n_nationkey < 8").select(
        F.col("n_nationkey").cast("string").alias("unit"),
        F.lit(None).cast("long").alias("ts"),
        F.lit(1 << 60).alias("seq"),
        F.lit(None).cast("string").alias("key"),
    )
    closed = state.unit_windows(d.unionByName(ends), (), base.SIZE, streams.HORIZON)
    window = F.expr("`window` DIV 1000000").alias("window_s")
    out = closed.select("unit", window, "sample_count", "duplicate_count", "late_count")
    return state.run_to_table(out, new_path(spark, "stream"))
