"""Writers for files and streams."""

from __future__ import annotations

import json
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.summary import json_lines
from .collections import collection_writer, read_collection, telemetry_store, window_store  # noqa: F401


def write_jsonl(df: DataFrame, path: str) -> None:
    json_lines(df).write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    if missing := sorted(set(columns) - set(df.columns)):
        raise ValueError(f"missing columns {missing}")
    df.select(*columns).write.mode("overwrite").option("header", True).csv(path)


def keyed_json(df: DataFrame, key: str = "ahu_id") -> DataFrame:
    """``key`` and JSON ``value``, as a topic wants them."""
    return df.select(
        F.col(key).cast("string").alias("key"),
        F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("value"),
    )


def kafka_stream(df: DataFrame, servers: str, topic: str, checkpoint: str):
    return keyed_json(df).writeStream.format("kafka").option(
        "kafka.bootstrap.servers", servers
    ).option("topic", topic).option("checkpointLocation", checkpoint).start()


def tee(*writers: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """One batch for several writers, computed once: for ``foreachBatch``."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            for w in writers:
                w(batch, batch_id)
        finally:
            batch.unpersist()

    return write


def print_rows(df: DataFrame, pretty: bool = False, show: Callable[[str], None] = print) -> int:
    """Rows as JSON, one a line or indented, to standard output; how many.  Rows come a partition at a time."""
    n = 0
    for row in json_lines(df).toLocalIterator():
        show(json.dumps(json.loads(row.value), indent=2, sort_keys=True, ensure_ascii=False) if pretty else row.value)
        n += 1
    return n


def write_metadata(scenario: dict, path: str) -> None:
    """A run's description beside its data."""
    Path(path).write_text(json.dumps(scenario, indent=2, sort_keys=True), encoding="utf-8")
