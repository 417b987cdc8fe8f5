"""Collections in buckets: what a batch rewrites, repeated batches, reviews, and lookups that read one file."""

import pytest
from pyspark.sql import functions as F

from airloom.sources import collections as C

from .test_engine import rows
from .test_serving import TICKETS


def files(path):
    return {f: f.stat().st_mtime_ns for f in path.rglob("*.parquet")}


def test_a_batch_rewrites_only_its_buckets(spark, tmp_path):
    at = tmp_path / "c"
    write = C.collection_writer(str(at), buckets=32)
    d = spark.range(2000).select(F.col("id").cast("string").alias("id"), F.lit("old").alias("v"))
    write(d, 0)
    before = files(at)
    assert len(before) == 32  # a file for each bucket
    batch = d.where("CAST(id AS INT) % 200 = 0").withColumn("v", F.lit("new"))
    assert batch.count() == 10
    write(batch, 1)
    after = files(at)
    changed = {f.parent.name for f in set(before) ^ set(after)}
    assert 0 < len(changed) <= 10
    got = C.read_collection(spark, str(at))
    assert got.count() == 2000 and got.where("v = 'new'").count() == 10
    write(batch.withColumn("v", F.lit("late")), 1)  # the same batch's number again
    assert files(at) == after
    write(batch, 2)  # the same rows in a new batch
    again = C.read_collection(spark, str(at))
    assert sum(r.v == 'new' for r in again.collect()) == 10
    assert again.count() == 2000 and again.where("v = 'new'").count() == 10
    kept = files(at)
    write(batch.where("false"), 3)
    assert files(at) == kept and C.read_collection(spark, str(at)).count() == 2000


def test_new_columns_and_nulls_of_keys(spark, tmp_path):
    write = C.collection_writer(str(tmp_path / "c"), order="n", buckets=4)
    write(spark.createDataFrame([("a", 1), ("a", 2), (None, 5)], "id string, n int"), 0)
    assert rows(C.read_collection(spark, str(tmp_path / "c")).na.fill("-"), "id", "n") == [("-", 5), ("a", 2)]


def test_a_lookup_reads_one_file(spark, tmp_path):
    at = str(tmp_path / "w")
    d = spark.range(5000).select(F.concat(F.lit("w"), "id").alias("window_id"), F.col("id").alias("v"))
    C.collection_writer(at, "window_id", buckets=16)(d, 0)
    one = C.find(spark, at, "window_id", "w1234", buckets=16)
    assert [r.v for r in one.collect()] == [1234]
    plan = one._jdf.queryExecution().executedPlan()
    scan = [n for n in leaves(plan) if "Scan parquet" in n.nodeName()][0]
    assert scan.metrics().apply("numFiles").value() == 1
    assert C.find(spark, at, "window_id", "nowhere", buckets=16).count() == 0
    asked = spark.createDataFrame([("w7",), ("w7",), ("w4999",), ("none",)], "window_id string")
    assert rows(C.find_all(spark, at, "window_id", asked, buckets=16), "window_id", "v") == [("w4999", 4999), ("w7", 7)]


def leaves(plan):
    if plan.nodeName().startswith("AdaptiveSparkPlan"):
        return leaves(plan.executedPlan())
    n = plan.children().size()
    return [x for i in range(n) for x in leaves(plan.children().apply(i))] or [plan]


def ticket(i):
    return (f"t{i}", f"TCK-{i:04x}", "a|F", "a", "F", "OPEN", "DRAFT", "NONE", 1, None, "2025", "2025", "2025")


def test_tickets_are_patched_and_reviewed_in_place(spark, tmp_path):
    at = tmp_path / "t"
    C.collection_writer(str(at), "ticket_id", buckets=16)(spark.createDataFrame([ticket(i) for i in range(100)], TICKETS), 0)
    before = files(at)
    patches = spark.createDataFrame(
        [("t3", 1, None, None, 7), ("t3", 2, None, None, 8), ("new", 1, "b", "G", 1)],
        "ticket_id string, seq int, ahu_id string, detected_fault_type string, occurrence_count int",
    )
    C.ticket_store(str(at), "2026", buckets=16)(patches, 0)
    assert len({f.parent for f in set(before) ^ set(files(at))}) <= 2
    got = {r.ticket_id: r for r in C.read_collection(spark, str(at)).collect()}
    assert len(got) == 101 and got["t3"].occurrence_count == 8 and got["new"].lifecycle_status == "OPEN"
    reviews = "ticket_id string, review_status string, review_notes string"
    notes = spark.createDataFrame([("t5", "APPROVED", "fine"), ("t6", "REJECTED", None)], reviews)
    C.review_tickets(str(at), notes, "2027", buckets=16)
    got = {r.ticket_id: (r.review_status, r.updated_at) for r in C.read_collection(spark, str(at)).collect()}
    assert got["t5"] == ("APPROVED", "2027") and got["t6"] == ("REJECTED", "2027") and got["t7"] == ("NONE", "2025")
    kept = files(at)
    for bad in ([("t5", "MAYBE", "x")], [("missing", "APPROVED", "x")], [("t5", "NONE", "x"), ("t5", "APPROVED", "y")]):
        with pytest.raises(Exception, match="review_status: MAYBE|no such ticket|reviewed twice"):
            C.review_tickets(str(at), spark.createDataFrame(bad, reviews), "2028", buckets=16)
    assert files(at) == kept
