"""Tickets: filter, sort, page, metrics, upsert, review."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import json_list, json_value, ticket_ref

# States, sort columns, columns that a patch can't change, and an insert's defaults.
STATES = {
    "lifecycle_status": ("OPEN", "RESOLVED"),
    "diagnosis_status": ("DRAFT", "DIAGNOSING", "DIAGNOSED", "FAILED"),
    "review_status": ("NONE", "APPROVED", "REJECTED"),
}
SORTS = ("updated_at", "created_at", "last_seen_at", "diagnosed_at", "resolved_at", "confidence", "ticket_ref")
IMMUTABLE = ("ticket_id", "ticket_ref", "incident_key", "created_at")
DEFAULTS = {
    "lifecycle_status": "OPEN",
    "diagnosis_status": "DRAFT",
    "review_status": "NONE",
    "occurrence_count": 0,
    "window_refs": "[]",
    "signatures_seen": "[]",
    "evidence_ids": "[]",
}
# Fixed value: hex digits of a reference, as long as no other ticket has them.
REFERENCE_DIGITS = 4
LISTS = ("evidence_ids", "window_refs", "signatures_seen")
SEARCHED = ("ticket_ref", "ticket_id", "detected_fault_type", "diagnosis_title")


def like_pattern(q: str) -> str:
    return "%" + q.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"


def list_tickets(
    df: DataFrame,
    *,
    q: str | None = None,
    min_confidence: float | None = None,
    ahu_id: str | None = None,
    fault_type: str | None = None,
    sort: str = "updated_at",
    order: str = "desc",
    limit: int = 100,
    offset: int = 0,
    count: bool = False,
    **states: str | None,
) -> DataFrame:
    """A page of the tickets that fit all filters, or with ``count`` how many there are.

    An unknown state is an error, an unknown sort column means updated_at; ties are sorted by ticket_id."""
    tests = []
    for k, v in states.items():
        if v:
            if v not in STATES[k]:
                raise ValueError(f"{k}: {v}")
            tests.append(F.col(k) == v)
    if ahu_id:
        tests.append(F.col("ahu_id") == ahu_id)
    if fault_type:
        tests.append(F.col("detected_fault_type") == fault_type)
    if min_confidence is not None:
        tests.append(F.col("confidence") >= min_confidence)
    if q:
        tests.append(
            reduce(lambda a, b: a | b, [F.coalesce(F.col(c).ilike(like_pattern(q)), F.lit(False)) for c in SEARCHED])
        )
    found = reduce(lambda d, t: d.where(t), tests, df)
    if count:
        return found.agg(F.count("*").alias("total"))
    by = sort if sort in SORTS else "updated_at"
    up = str(order).lower() == "asc"
    return found.orderBy(
        F.col(by).asc_nulls_first() if up else F.col(by).desc_nulls_last(), "ticket_id"
    ).offset(max(0, offset)).limit(max(1, limit))


def metrics(df: DataFrame, high_confidence: float = 0.6) -> DataFrame:
    done = F.col("diagnosis_status") == "DIAGNOSED"
    return df.agg(
        F.count_if(F.col("lifecycle_status") == "OPEN").alias("active_count"),
        F.count_if((F.col("review_status") == "NONE") & done).alias("awaiting_review_count"),
        F.count_if(F.col("review_status") == "APPROVED").alias("approved_count"),
        F.count_if(F.col("review_status") == "REJECTED").alias("rejected_count"),
        F.count_if(done & (F.col("confidence") >= high_confidence)).alias("high_confidence_count"),
    )


def references(new: DataFrame, taken: DataFrame | None = None) -> DataFrame:
    """(ticket_id, ticket_ref) of new tickets: the least digits of the id's hash that no other ticket has.

    New tickets that share digits all get more; references in ``taken`` (ticket_ref) stay with their tickets.
    """
    ids = new.select("ticket_id").distinct()
    short = ids.withColumn("ticket_ref", ticket_ref(F.col("ticket_id"), F.lit(REFERENCE_DIGITS)))
    met = F.count("*").over(Window.partitionBy("ticket_ref")) > 1
    if taken is not None:
        known = taken.select("ticket_ref").distinct().withColumn("__taken", F.lit(True))
        short = short.join(known, "ticket_ref", "left")
        met = met | F.coalesce("__taken", F.lit(False))
    short = short.withColumn("met", met)
    # those that meet share their digits, so longer ones are compared among themselves only
    widths = F.array(*[F.lit(n) for n in (*range(REFERENCE_DIGITS + 1, 13), 16, 40)])
    wide = short.where("met").select("ticket_id", F.explode(widths).alias("n"))
    wide = wide.withColumn("ticket_ref", ticket_ref(F.col("ticket_id"), F.col("n")))
    once = wide.groupBy("ticket_ref").agg(
        F.count("*").alias("c"), F.min("ticket_id").alias("ticket_id"), F.min("n").alias("n")
    )
    free = once.where("c = 1")
    if taken is not None:
        free = free.join(taken.select("ticket_ref").distinct(), "ticket_ref", "left_anti")
    longer = free.groupBy("ticket_id").agg(F.min_by("ticket_ref", "n").alias("ticket_ref"))
    return short.where("NOT met").select("ticket_id", "ticket_ref").unionByName(longer)


def upsert(
    tickets: DataFrame, patches: DataFrame, now: str, sequence: str = "seq", incomplete: str = "raise"
) -> DataFrame:
    """Tickets after patches: a null keeps what is there, the last non-null of a ticket's patches wins.

    A ticket's identity and creation stay; a new one needs a unit and a fault and gets the defaults and a
    reference of its own.  One without them is an error when the result is computed, or with ``incomplete``
    "leave out" goes.  Unknown states are errors too.
    """
    fields = [c for c in patches.columns if c not in ("ticket_id", sequence)]
    w = Window.partitionBy("ticket_id").orderBy(sequence)
    all_rows = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    lasts = [F.last(c, ignorenulls=True).over(all_rows).alias(f"__{c}") for c in fields]
    last = patches.select("ticket_id", F.row_number().over(w).alias("__n"), *lasts)
    last = last.where("__n = 1").drop("__n").withColumn("__patch", F.lit(True))
    both = tickets.withColumn("__old", F.lit(True)).join(last, "ticket_id", "full")
    old, patched = F.col("__old").isNotNull(), F.col("__patch").isNotNull()
    needed = [F.coalesce(F.trim(f"__{c}"), F.lit("")) != "" for c in ("ahu_id", "detected_fault_type") if c in fields]
    whole = needed[0] & needed[1] if len(needed) == 2 else F.lit(False)
    if incomplete == "raise":
        message = F.concat(F.lit("a new ticket needs ahu_id and detected_fault_type: "), F.col("ticket_id"))
        both = both.where(F.when(old | whole, F.lit(True)).otherwise(F.raise_error(message).cast("boolean")))
    else:
        both = both.where(old | whole)
    if "ticket_ref" in tickets.columns:
        fresh = last.join(tickets.select("ticket_id"), "ticket_id", "left_anti")
        named = references(fresh, tickets).withColumnRenamed("ticket_ref", "__new_ref")
        both = both.join(named, "ticket_id", "left")
    created = F.coalesce("__created_at", F.lit(now)) if "created_at" in fields else F.lit(now)
    out = []
    for c in tickets.columns:
        new = F.col(f"__{c}") if c in fields else F.lit(None)
        if c in STATES and c in fields:
            known = new.isNull() | new.isin(*STATES[c])
            new = F.when(known, new).otherwise(F.raise_error(F.concat(F.lit(f"{c}: "), new)).cast("string"))
        kept = F.when(old, F.col(c))
        if c == "ticket_id":
            out.append(F.col(c))
        elif c == "updated_at":
            out.append(
                F.when(old & patched, F.lit(now)).when(old, F.col(c)).otherwise(F.coalesce(new, created)).alias(c)
            )
        elif c == "created_at":
            out.append(F.when(old, F.col(c)).otherwise(created).alias(c))
        elif c == "ticket_ref":
            out.append(F.when(old, F.col(c)).otherwise(F.coalesce(new, F.col("__new_ref"))).alias(c))
        elif c == "incident_key":
            key = F.concat_ws("|", "__ahu_id", "__detected_fault_type") if len(needed) == 2 else F.lit(None)
            out.append(F.when(old, F.col(c)).otherwise(F.coalesce(new, key)).alias(c))
        elif c == "last_seen_at":
            out.append(F.coalesce(new, kept, F.when(~old, created)).alias(c))
        elif c in DEFAULTS:
            out.append(F.coalesce(new, kept, F.when(~old, F.lit(DEFAULTS[c]))).alias(c))
        else:
            out.append(F.coalesce(new, kept).alias(c))
    return both.select(*out)


def api_rows(tickets: DataFrame) -> DataFrame:
    """Tickets as the API gives them: lists from JSON text, recommended actions as any JSON value (in compact text)."""
    lists = {c: json_list(F.col(c)) for c in LISTS if c in tickets.columns}
    value = {c: json_value(F.col(c)) for c in ("recommended_actions",) if c in tickets.columns}
    return tickets.withColumns(lists | value) if lists or value else tickets


def review(tickets: DataFrame, ticket_id: str, status: str, notes: str | None, now: str) -> DataFrame:
    if status not in STATES["review_status"]:
        raise ValueError(f"review_status: {status}")
    if tickets.where(F.col("ticket_id") == ticket_id).isEmpty():
        raise KeyError(ticket_id)
    own = F.col("ticket_id") == ticket_id
    return tickets.withColumns(
        {
            "review_status": F.when(own, F.lit(status)).otherwise(F.col("review_status")),
            "review_notes": F.when(own, F.lit(notes)).otherwise(F.col("review_notes")),
            "updated_at": F.when(own, F.lit(now)).otherwise(F.col("updated_at")),
        }
    )


def review_all(tickets: DataFrame, reviews: DataFrame, now: str) -> DataFrame:
    """Tickets after ``reviews`` (ticket_id, review_status, review_notes), at most one for each ticket.

    A status that isn't known, a ticket that isn't there and a second review of one are errors of the job.
    """
    known = F.col("review_status").isin(*STATES["review_status"])
    fail = lambda text, c: F.raise_error(F.concat(F.lit(f"{text}: "), c)).cast("boolean")
    n = F.count("*").over(Window.partitionBy("ticket_id"))
    checked = reviews.withColumn("__n", n).where(
        F.when(~F.coalesce(known, F.lit(False)), fail("review_status", F.coalesce("review_status", F.lit("null"))))
        .when(F.col("__n") > 1, fail("reviewed twice", F.col("ticket_id")))
        .otherwise(True)
    )
    own = checked.select(
        "ticket_id", F.col("review_status").alias("__status"), F.col("review_notes").alias("__notes"), F.lit(True).alias("__own")
    )
    both = tickets.withColumn("__there", F.lit(True)).join(own, "ticket_id", "full")
    both = both.where(F.when(F.col("__there"), True).otherwise(fail("no such ticket", F.col("ticket_id"))))
    new = {"review_status": F.col("__status"), "review_notes": F.col("__notes"), "updated_at": F.lit(now)}
    return both.select(
        *[F.when(F.col("__own"), new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in tickets.columns]
    )


def get_ticket(tickets: DataFrame, name: str) -> DataFrame:
    """By reference where the name starts with ``TCK-``, else by id."""
    return tickets.where(F.col("ticket_ref" if name.startswith("TCK-") else "ticket_id") == name).limit(1)


def active_ticket(incidents: DataFrame, tickets: DataFrame) -> DataFrame:
    """Incidents with the latest open ticket of their key, if any."""
    w = Window.partitionBy("incident_key").orderBy(F.desc("updated_at"), "ticket_id")
    one = tickets.where("lifecycle_status = 'OPEN'").withColumn("__n", F.row_number().over(w)).where("__n = 1").select(
        "incident_key", "ticket_id", "ticket_ref"
    )
    return incidents.join(one, "incident_key", "left")


def state_matrix(spark) -> DataFrame:
    """All combinations of the states: three short literal lists."""
    out = None
    for k, v in STATES.items():
        d = spark.createDataFrame([(x,) for x in v], f"{k} string")
        out = d if out is None else out.crossJoin(d)
    return out
