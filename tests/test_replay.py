"""A paced replay: speeds give the same rows, a pause holds, and a restart goes on where it stood."""

import time

import pytest
from pyspark.sql import functions as F

from airloom.sources import replay

from .test_engine import rows


@pytest.fixture(scope="module")
def staged(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("replay")
    d = spark.range(120).select(
        F.col("id"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 5).alias("timestamp"), (F.col("id") % 3).cast("string").alias("ahu_id")
    )
    replay.stage(d, str(at / "t"), files=4)
    return str(at / "t"), d.schema


def run(spark, staged, tmp_path, speed, idle=6.0, **more):
    path, schema = staged
    s = replay.replay(spark, path, schema, speed, **more)
    q = s.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(
        processingTime="200 milliseconds"
    ).start(str(tmp_path / "out"))
    return q


def test_speeds_give_the_same_rows(spark, staged, tmp_path):
    want = [(i,) for i in range(120)]
    for speed in (0, 100):
        (tmp_path / str(speed)).mkdir()
        began = time.monotonic()
        q = run(spark, staged, tmp_path / str(speed), speed)
        replay.run_until_idle(q, 6.0)
        took = time.monotonic() - began
        out = spark.read.parquet(str(tmp_path / str(speed) / "out"))
        assert rows(out, "id") == want
        batches = len(q.recentProgress)
        if speed:
            assert took > 5.95 and batches > 2  # 595 seconds of events at a hundred times their pace


def test_a_pause_holds_and_a_restart_goes_on(spark, staged, tmp_path):
    stop = tmp_path / "pause"
    q = run(spark, staged, tmp_path, 0, pause_file=str(stop), max_seconds=50)
    while not q.recentProgress or not any(p["numInputRows"] for p in q.recentProgress):
        time.sleep(0.1)
    stop.touch()
    time.sleep(2.5)
    held = spark.read.parquet(str(tmp_path / "out")).count()
    time.sleep(1.5)
    assert spark.read.parquet(str(tmp_path / "out")).count() == held
    q.stop()
    stop.unlink()
    again = run(spark, staged, tmp_path, 0)
    replay.run_until_idle(again, 5.0)
    assert rows(spark.read.parquet(str(tmp_path / "out")), "id") == [(i,) for i in range(120)]


def test_rows_without_a_time_are_an_error(spark, tmp_path):
    d = spark.createDataFrame([(1, None)], "id int, timestamp timestamp")
    with pytest.raises(Exception, match="a row without timestamp"):
        replay.stage(d, str(tmp_path / "t"))
