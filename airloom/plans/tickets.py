"""Ticket queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import tickets as T
from ..sources.adapter import TICKETS_SQL, read, tickets

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query(
    f"WITH {TICKETS_SQL} SELECT ticket_id, updated_at, confidence FROM tk "
    f"WHERE lifecycle_status = 'OPEN' AND confidence >= 0.3 AND diagnosis_title ILIKE '%case\\_1%' ESCAPE '\\' "
    f"ORDER BY updated_at DESC NULLS LAST, ticket_id LIMIT 50 OFFSET 10"
)
def q35_tickets_list(spark, sf) -> DataFrame:
    page = T.list_tickets(
        tickets(spark, sf),
        q="case_1",
        min_confidence=0.3,
        lifecycle_status="OPEN",
        sort="nonsense",
        limit=50,
        offset=10,
    )
    return page.select("ticket_id", "updated_at", "confidence")


@query(
    f"WITH {TICKETS_SQL} SELECT count(*) FILTER (WHERE lifecycle_status = 'OPEN') AS active_count, "
    f"count(*) FILTER (WHERE review_status = 'NONE' "
    f"AND diagnosis_status = 'DIAGNOSED') AS awaiting_review_count, "
    f"count(*) FILTER (WHERE review_status = 'APPROVED') AS approved_count, "
    f"count(*) FILTER (WHERE review_status = 'REJECTED') AS rejected_count, "
    f"count(*) FILTER (WHERE diagnosis_status = 'DIAGNOSED' AND confidence >= 0.6) AS high_confidence_count "
    f"FROM tk"
)
def q36_ticket_metrics(spark, sf) -> DataFrame:
    return T.metrics(tickets(spark, sf))


_PATCHES = f"""{TICKETS_SQL},
pt AS (SELECT 't' || o_orderkey::VARCHAR AS ticket_id, 1 AS seq, CASE
  WHEN o_orderkey % 2 = 0 THEN 'RESOLVED' END AS lifecycle_status, 0.9::DOUBLE AS confidence, '9' AS ahu_id,
  NULL::VARCHAR AS detected_fault_type FROM orders WHERE o_orderkey % 10 = 0
       UNION ALL SELECT 't' || o_orderkey::VARCHAR, 2, NULL, CASE
       WHEN o_orderkey % 4 = 0 THEN 0.4::DOUBLE END, NULL, NULL FROM orders WHERE o_orderkey % 20 = 0
       UNION ALL SELECT 'n' || o_orderkey::VARCHAR, 3, NULL, 0.2::DOUBLE, '3', CASE
       WHEN o_orderkey % 3 = 0 THEN 'X' END FROM orders WHERE o_orderkey % 50 = 0),
l AS (SELECT ticket_id, max_by(lifecycle_status, seq) FILTER (WHERE lifecycle_status IS NOT NULL) AS lifecycle_status,
  max_by(confidence, seq) FILTER (WHERE confidence IS NOT NULL) AS confidence, max_by(ahu_id,
  seq) FILTER (WHERE ahu_id IS NOT NULL) AS ahu_id, max_by(detected_fault_type,
  seq) FILTER (WHERE detected_fault_type IS NOT NULL) AS detected_fault_type FROM pt GROUP BY 1)"""


@query(f"""WITH {_PATCHES} SELECT coalesce(tk.ticket_id, l.ticket_id) AS ticket_id, coalesce(tk.incident_key,
  l.ahu_id || '|' || l.detected_fault_type) AS incident_key, coalesce(l.lifecycle_status, tk.lifecycle_status,
  'OPEN') AS lifecycle_status,
  coalesce(l.confidence, tk.confidence) AS confidence, coalesce(l.ahu_id, tk.ahu_id) AS ahu_id,
  coalesce(tk.created_at, '2025-01-01') AS created_at, CASE WHEN l.ticket_id IS NOT NULL THEN '2025-01-01'
  ELSE tk.updated_at END AS updated_at, coalesce(tk.occurrence_count, 0) AS occurrence_count
  FROM tk FULL JOIN l ON tk.ticket_id = l.ticket_id WHERE tk.ticket_id IS NOT NULL OR (l.ahu_id IS NOT NULL
  AND l.detected_fault_type IS NOT NULL)""")
def q37_ticket_upsert(spark, sf) -> DataFrame:
    o = read(spark, sf, "orders")
    null = "CAST(NULL AS STRING)"
    a = o.where("o_orderkey % 10 = 0").selectExpr(
        "concat('t', o_orderkey) AS ticket_id",
        "1 AS seq",
        "CASE WHEN o_orderkey % 2 = 0 THEN 'RESOLVED' END AS lifecycle_status",
        "0.9D AS confidence",
        "'9' AS ahu_id",
        f"{null} AS detected_fault_type",
    )
    b = o.where("o_orderkey % 20 = 0").selectExpr(
        "concat('t', o_orderkey)", "2", null, "CASE WHEN o_orderkey % 4 = 0 THEN 0.4D END", null, null
    )
    c = o.where("o_orderkey % 50 = 0").selectExpr(
        "concat('n', o_orderkey)", "3", null, "0.2D", "'3'", "CASE WHEN o_orderkey % 3 = 0 THEN 'X' END"
    )
    out = T.upsert(tickets(spark, sf), a.union(b).union(c), "2025-01-01", incomplete="leave out")
    return out.select(
        "ticket_id",
        "incident_key",
        "lifecycle_status",
        "confidence",
        "ahu_id",
        "created_at",
        "updated_at",
        "occurrence_count",
    )


@query(
    f"WITH {TICKETS_SQL}, i AS (SELECT c_custkey, (c_custkey % 8)::VARCHAR || '|' || '1-URGENT' AS incident_key "
    f"FROM customer), o AS (SELECT incident_key, ticket_id FROM (SELECT *, "
    f"row_number() OVER (PARTITION BY incident_key ORDER BY updated_at DESC, ticket_id) AS n FROM tk "
    f"WHERE lifecycle_status = 'OPEN') WHERE n = 1) SELECT c_custkey, i.incident_key, ticket_id FROM i LEFT "
    f"JOIN o ON i.incident_key = o.incident_key"
)
def q38_active_ticket_lookup(spark, sf) -> DataFrame:
    i = read(spark, sf, "customer").select(
        "c_custkey", F.concat((F.col("c_custkey") % 8).cast("string"), F.lit("|1-URGENT")).alias("incident_key")
    )
    return T.active_ticket(i, tickets(spark, sf)).select("c_custkey", "incident_key", "ticket_id")


@query(
    "SELECT * FROM (VALUES ('OPEN'), ('RESOLVED')) a(lifecycle_status), (VALUES ('DRAFT'), ('DIAGNOSING'), "
    "('DIAGNOSED'), ('FAILED')) b(diagnosis_status), (VALUES ('NONE'), ('APPROVED'), "
    "('REJECTED')) c(review_status)"
)
def q39_enum_matrix(spark, sf) -> DataFrame:
    return T.state_matrix(spark)


@query(f"WITH {TICKETS_SQL} SELECT count(*) AS total FROM tk WHERE ahu_id = '3' AND review_status = 'APPROVED'")
def q57_ticket_count(spark, sf) -> DataFrame:
    return T.list_tickets(tickets(spark, sf), ahu_id="3", review_status="APPROVED", count=True)
