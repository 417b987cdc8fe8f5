"""Keyed collections in hash buckets: writes replace the buckets they touch, lookups read one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import tickets as T
from ..operators.live import KEPT_WINDOWS, retain, ring_buffer
from ..operators.retrieval import upsert_documents
from ..staging import Scratch

#: Folder level that holds a collection's buckets, as Spark's partitions are named.
BUCKET = "bucket"
BUCKETS = 64


def bucket_of(by: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(by.cast("string")), F.lit(buckets)).cast("int")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a write to the collection has ended."""
    p, fs = _file(spark, path)
    return fs.exists(p) and any(s.getPath().getName().startswith(BUCKET) for s in fs.listStatus(p))


def read_buckets(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", True).parquet(path)


def read_collection(spark: SparkSession, path: str) -> DataFrame:
    return read_buckets(spark, path).drop(BUCKET)


def rewrite(
    spark: SparkSession,
    path: str,
    batch: DataFrame,
    merge: Callable[[DataFrame | None, DataFrame], DataFrame],
    by: str,
    buckets: int,
    sort: str,
    batch_of: tuple[str, int] | None = None,
) -> None:
    """Replace the buckets that ``batch`` touches by what ``merge`` makes of them and of the batch.

    The new rows are staged before any folder is replaced.  A bucket's file is sorted by ``sort`` and has a Bloom
    filter on it.  ``batch_of``: the kind of writer and the batch's number; a query's number that has been written
    changes nothing.  A collection has one writer at a time.
    """
    mark = None
    if batch_of:
        query = spark.sparkContext.getLocalProperty("sql.streaming.queryId") or "batches"
        mark = f"{path}/_written/{batch_of[0]}-{query}"
        if (last := read_mark(spark, mark)) is not None and last >= batch_of[1]:
            return
    scratch = Scratch(spark)
    new = scratch.keep(batch.withColumn(BUCKET, bucket_of(F.col(by), buckets)), "batch")
    touched = [r[0] for r in new.select(BUCKET).distinct().collect()]  # a number for each bucket at most
    if touched:
        old = read_buckets(spark, path).where(F.col(BUCKET).isin(touched)) if exists(spark, path) else None
        merged = merge(old.drop(BUCKET) if old is not None else None, new.drop(BUCKET))
        merged = scratch.keep(merged.withColumn(BUCKET, bucket_of(F.col(by), buckets)), "merged")
        out = merged.repartition(min(len(touched), buckets), BUCKET).sortWithinPartitions(BUCKET, sort)
        out.write.partitionBy(BUCKET).mode("overwrite").option("partitionOverwriteMode", "dynamic").option(
            f"parquet.bloom.filter.enabled#{sort}", "true"
        ).parquet(path)
    scratch.drop(*[table for _, table in list(scratch.paths.values())])
    if mark:
        write_mark(spark, mark, batch_of[1])


def _file(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def read_mark(spark: SparkSession, path: str) -> int | None:
    """The number of the last batch that a writer has ended."""
    p, fs = _file(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return int(stream.readLong())
    finally:
        stream.close()


def write_mark(spark: SparkSession, path: str, number: int) -> None:
    p, fs = _file(spark, path)
    stream = fs.create(p, True)
    try:
        stream.writeLong(number)
    finally:
        stream.close()


def last_of_batch(batch: DataFrame, key: str, order: str | None) -> DataFrame:
    """Of equal keys the row with the greatest ``order``; without it equal keys are an error, as none is the last."""
    if order:
        best = Window.partitionBy(key).orderBy(F.desc(order))
        return batch.withColumn("__n", F.row_number().over(best)).where("__n = 1").drop("__n")
    twice = F.raise_error(F.concat(F.lit("equal keys in a batch without order: "), F.col(key).cast("string")))
    n = F.count("*").over(Window.partitionBy(key))
    new = batch.withColumn("__n", n).where(F.when(F.col("__n") == 1, True).otherwise(twice.cast("boolean")))
    return new.drop("__n")


def collection_writer(
    path: str,
    key: str = "id",
    order: str | None = None,
    keep: Callable[[DataFrame], DataFrame] | None = None,
    by: str | None = None,
    buckets: int = BUCKETS,
) -> Callable[[DataFrame, int], None]:
    """Upserts batches into a parquet collection of ``buckets`` by the hash of ``by`` (the key).

    Only buckets with keys of the batch are read and written.  Of a batch's rows with equal keys the one with
    the greatest ``order`` wins; without ``order`` equal keys in a batch are an error.  ``keep`` says what a store
    retains of a bucket, such as the newest minutes or windows of each unit; ``by`` is the unit then.  A key
    stays in its bucket as long as its ``by`` doesn't change.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        def merge(old: DataFrame | None, new: DataFrame) -> DataFrame:
            new = last_of_batch(new, key, order)
            out = upsert_documents(old, new, key) if old is not None else new
            return keep(out) if keep else out

        rewrite(batch.sparkSession, path, batch, merge, by or key, buckets, key, ("rows", batch_id))

    return write


def telemetry_store(path: str, minutes: int = 30) -> Callable[[DataFrame, int], None]:
    """A writer of telemetry (``row_id``, ahu_id, timestamp, ...) that retains each unit's last minutes."""
    return collection_writer(path, "row_id", keep=lambda d: retain(d, "ahu_id", "timestamp", minutes), by="ahu_id")


def window_store(path: str, arrival: str, maxlen: int = KEPT_WINDOWS) -> Callable[[DataFrame, int], None]:
    """A writer of window summaries that retains each unit's newest ``maxlen`` arrivals."""
    keep = lambda d: ring_buffer(d, arrival, maxlen)
    return collection_writer(path, "window_id", arrival, keep=keep, by="ahu_id")


def ticket_store(path: str, now: str, buckets: int = BUCKETS, incomplete: str = "raise"):
    """A writer of ticket patches (``ticket_id``, ``seq``, fields) into a collection; see ``tickets.upsert``.

    References of new tickets are checked against those of the buckets that the batch touches.
    """

    def write(patches: DataFrame, batch_id: int) -> None:
        def merge(old: DataFrame | None, new: DataFrame) -> DataFrame:
            if old is None:
                raise ValueError(f"{path}: no tickets yet")
            return T.upsert(old, new, now, incomplete=incomplete)

        rewrite(patches.sparkSession, path, patches, merge, "ticket_id", buckets, "ticket_id", ("patches", batch_id))

    return write


def review_tickets(path: str, reviews: DataFrame, now: str, buckets: int = BUCKETS) -> None:
    """Write ``reviews`` (ticket_id, review_status, review_notes) into the tickets at ``path``.

    An unknown status or ticket is an error of the job that meets it, and nothing is replaced then.
    """

    def merge(old: DataFrame | None, new: DataFrame) -> DataFrame:
        if old is None:
            raise KeyError("no tickets yet")
        return T.review_all(old, new, now)

    rewrite(reviews.sparkSession, path, reviews, merge, "ticket_id", buckets, "ticket_id")


def find(spark: SparkSession, path: str, key: str, value: str, buckets: int = BUCKETS) -> DataFrame:
    """A collection's row with the key: its bucket's folder is the only one that is read."""
    own = bucket_of(F.lit(value), buckets)
    return read_buckets(spark, path).where((F.col(BUCKET) == own) & (F.col(key) == value)).drop(BUCKET)


def find_all(spark: SparkSession, path: str, key: str, asked: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Rows of the collection whose key is in ``asked`` (a column of that name): the buckets asked for meet theirs."""
    want = asked.select(key).distinct().withColumn(BUCKET, bucket_of(F.col(key), buckets))
    return read_buckets(spark, path).join(want, [BUCKET, key], "left_semi").drop(BUCKET)
