"""The driver's tables seen as telemetry, tickets, manuals and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# One expression per column, the same in Spark and in the SQL oracle.
TELEMETRY = {
    "oa_temp": "CAST(20 AS DOUBLE) + k / CAST(10 AS DOUBLE)",
    "ra_temp": "CASE WHEN EXTRACT(DAY FROM ts) % 7 = 0 THEN NULL ELSE CAST(24 AS DOUBLE) + k / CAST(50 AS DOUBLE) END",
    "ma_temp": "CASE WHEN EXTRACT(DAY FROM ts) % 7 = 0 THEN NULL ELSE CAST(18 AS DOUBLE) + k / CAST(20 AS DOUBLE) END",
    "sa_temp": "CASE WHEN event_id % 13 = 0 THEN NULL ELSE CAST(11 AS DOUBLE) + k / CAST(12 AS DOUBLE) END",
    "sa_temp_sp": "CAST(14 AS DOUBLE)",
    "avg_zone_temp": "CAST(22 AS DOUBLE) + k / CAST(40 AS DOUBLE)",
    "cc_valve": "LEAST(CAST(100 AS DOUBLE), CAST(40 AS DOUBLE) + value)",
    "oa_damper": "CASE WHEN EXTRACT(DAY FROM ts) % 5 = 0 THEN CAST(100 AS DOUBLE) ELSE CAST(k AS DOUBLE) END",
    "ra_damper": "CASE WHEN EXTRACT(DAY FROM ts) % 5 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(100 - k AS DOUBLE) END",
    "sa_fan_speed": "CASE WHEN EXTRACT(DAY FROM ts) % 7 = 0 THEN NULL ELSE CAST(50 AS DOUBLE) + k / CAST(4 AS DOUBLE) END",
}


def read(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def telemetry(spark, sf_dir: str) -> DataFrame:
    """``events`` as ten signals of eight units."""
    e = read(spark, sf_dir, "events").withColumn(
        "k", F.get_json_object("props", "$.k").cast("int")
    ).withColumn("ts", F.col("ts").cast("timestamp"))
    return e.selectExpr(
        "event_id",
        "CAST(user_id % 8 AS STRING) AS ahu_id",
        "ts AS timestamp",
        "k",
        *[f"{x} AS {n}" for n, x in TELEMETRY.items()],
    )


def tickets(spark, sf_dir: str) -> DataFrame:
    """``orders`` as tickets."""
    o = read(spark, sf_dir, "orders")
    return o.selectExpr(
        "concat('t', CAST(o_orderkey AS STRING)) AS ticket_id", "concat('TCK-', CAST(o_orderkey AS STRING)) AS ticket_ref", "CAST(o_custkey % 8 AS STRING) AS ahu_id",
        "concat(CAST(o_custkey % 8 AS STRING), '|', o_orderpriority) AS incident_key", "o_orderpriority AS detected_fault_type", "CASE WHEN o_orderstatus = 'O' THEN 'OPEN' ELSE 'RESOLVED' END AS lifecycle_status",
        "CASE o_orderkey % 4 WHEN 0 THEN 'DRAFT' WHEN 1 THEN 'DIAGNOSING' WHEN 2 THEN 'DIAGNOSED' ELSE 'FAILED' END AS diagnosis_status", "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_custkey % 100 AS DOUBLE) / CAST(100 AS DOUBLE) END AS confidence",
        "CAST(o_custkey % 7 AS INT) AS occurrence_count", "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE concat('Case_', CAST(o_custkey % 50 AS STRING), '%') END AS diagnosis_title",
        "CASE o_orderkey % 3 WHEN 0 THEN 'NONE' WHEN 1 THEN 'APPROVED' ELSE 'REJECTED' END AS review_status", "CAST(NULL AS STRING) AS review_notes",
        "date_format(CAST(o_orderdate AS TIMESTAMP), 'yyyy-MM-dd') AS created_at", "date_format(CAST(o_orderdate AS TIMESTAMP), 'yyyy-MM-dd') AS updated_at",
    )


TICKETS_SQL = """tk AS (SELECT 't' || o_orderkey::VARCHAR AS ticket_id, 'TCK-' || o_orderkey::VARCHAR AS ticket_ref,
  (o_custkey % 8)::VARCHAR AS ahu_id,
  (o_custkey % 8)::VARCHAR || '|' || o_orderpriority AS incident_key, o_orderpriority AS detected_fault_type, CASE
  WHEN o_orderstatus = 'O' THEN 'OPEN' ELSE 'RESOLVED' END AS lifecycle_status,
  CASE o_orderkey % 4 WHEN 0 THEN 'DRAFT' WHEN 1 THEN 'DIAGNOSING' WHEN 2 THEN 'DIAGNOSED'
  ELSE 'FAILED' END AS diagnosis_status, CASE WHEN o_orderkey % 5 = 0 THEN NULL
  ELSE CAST(o_custkey % 100 AS DOUBLE) / 100.0::DOUBLE END AS confidence,
  CAST(o_custkey % 7 AS INT) AS occurrence_count, CASE WHEN o_orderkey % 3 = 0 THEN NULL
  ELSE 'Case_' || (o_custkey % 50)::VARCHAR || '%' END AS diagnosis_title,
  CASE o_orderkey % 3 WHEN 0 THEN 'NONE' WHEN 1 THEN 'APPROVED' ELSE 'REJECTED' END AS review_status,
  strftime(o_orderdate, '%Y-%m-%d') AS created_at, strftime(o_orderdate, '%Y-%m-%d') AS updated_at FROM orders)"""

TELEMETRY_SQL = "tel AS (SELECT event_id, CAST(user_id % 8 AS VARCHAR) AS ahu_id, ts, epoch_us(ts) // 1000000 AS ts_s, k, " + ", ".join(f"{x} AS {n}" for n, x in TELEMETRY.items()) + " FROM (SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events))"


def page_table(spark, sf_dir: str) -> DataFrame:
    """``documents`` as manuals: a source is a document, each of its rows a page."""
    return read(spark, sf_dir, "documents").selectExpr("source AS doc_id", "doc_id AS page_no", "text")
