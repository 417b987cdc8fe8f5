"""Replay of a table as a stream, paced by its own event times."""

from __future__ import annotations

import time
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

NAME = "airloom_replay"
#: Microseconds of the time column in a staged file's name.
TIME = "__at_us"


def stage(df: DataFrame, path: str, time_column: str = "timestamp", files: int | None = None) -> None:
    """Write ``df`` in ranges of event time, each file sorted, so that a replay reads the row groups it needs.

    Rows without a time are an error: a replay can't place them.  ``path`` must be a folder that executors share.
    """
    at = F.unix_micros(time_column)
    placed = F.when(at.isNotNull(), at).otherwise(F.raise_error(F.lit(f"a row without {time_column}")).cast("long"))
    d = df.withColumn(TIME, placed)
    n = files or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d.repartitionByRange(n, TIME).sortWithinPartitions(TIME).write.mode("overwrite").option(
        "parquet.block.size", 8 << 20
    ).parquet(path)


class Slice(InputPartition):
    """Row groups of a file between two times."""

    def __init__(self, file: str, groups: list[int], after: int, until: int):
        self.file, self.groups, self.after, self.until = file, groups, after, until


class ReplayReader(DataSourceStreamReader):
    """Offsets are event times: a batch has the rows after one and up to the next.

    With ``speed`` 0 a batch goes to the end of the data, else event time runs that many times as fast as the clock,
    from the first row or from where the query's checkpoint stands.  While the file ``pauseFile`` is there, it
    stands still.  ``maxSeconds`` bounds a batch in event time.
    """

    def __init__(self, schema: StructType, options: dict):
        self.schema, self.path = schema, options["path"].removeprefix("file:").replace("///", "/")
        self.speed = float(options.get("speed", "1"))
        self.pause = options.get("pausefile")
        self.most = int(float(options.get("maxseconds", "0")) * 1e6)
        self.bounds = self._bounds()
        self.at: int | None = None  # where the replay's clock stands
        self.seen: float | None = None  # when it was read last

    def _bounds(self) -> list[tuple[str, int, int, int]]:
        """(file, row group, first time, last time), from the files' footers."""
        out = []
        for f in sorted(Path(self.path).glob("*.parquet")):
            meta = pq.ParquetFile(f).metadata
            column = next(i for i in range(meta.num_columns) if meta.schema.column(i).path == TIME)
            for g in range(meta.num_row_groups):
                s = meta.row_group(g).column(column).statistics
                if s is not None and s.has_min_max:
                    out.append((str(f), g, s.min, s.max))
        return out

    def initialOffset(self) -> dict:
        return {"at": min((b[2] for b in self.bounds), default=0) - 1}

    def latestOffset(self) -> dict:
        end = max((b[3] for b in self.bounds), default=self.initialOffset()["at"])
        if self.at is None:
            self.at = self.initialOffset()["at"]
        now = time.monotonic()
        if self.pause and Path(self.pause).exists():
            self.seen = now
            return {"at": self.at}
        if self.speed <= 0:
            ahead = end if not self.most else self.at + self.most
        elif self.seen is None:  # the first row is due at once
            ahead = self.at + 1
        else:
            ahead = self.at + int((now - self.seen) * self.speed * 1e6)
        if self.most:
            ahead = min(ahead, self.at + self.most)
        self.seen = now
        self.at = max(self.at, min(end, ahead))
        return {"at": self.at}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.at = max(self.at or 0, end["at"])
        wanted: dict[str, list[int]] = {}
        for file, group, low, high in self.bounds:
            if high > start["at"] and low <= end["at"]:
                wanted.setdefault(file, []).append(group)
        return [Slice(f, groups, start["at"], end["at"]) for f, groups in wanted.items()] or [Slice("", [], 0, 0)]

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        f = pq.ParquetFile(partition.file, coerce_int96_timestamp_unit="us")
        names = [c.name for c in self.schema.fields]
        kinds = to_arrow_schema(self.schema)
        for batch in f.iter_batches(row_groups=partition.groups):
            at = batch.column(batch.schema.get_field_index(TIME))
            rows = batch.filter(pc.and_(pc.greater(at, partition.after), pc.less_equal(at, partition.until)))
            if len(rows):
                columns = [rows.column(c).cast(kinds.field(c).type) for c in names]
                yield pa.RecordBatch.from_arrays(columns, schema=kinds)

    def commit(self, end: dict) -> None:
        self.at = max(self.at or 0, end["at"])


class Replay(DataSource):
    """``spark.readStream.format(NAME)`` over a staged folder; options path, speed, pauseFile, maxSeconds."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        raise ValueError("a replay needs the schema of the table that was staged")

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return ReplayReader(schema, dict(self.options))


def replay(
    spark: SparkSession,
    path: str,
    schema: StructType,
    speed: float = 1.0,
    pause_file: str | None = None,
    max_seconds: float = 0,
) -> DataFrame:
    """A folder of ``stage`` as a stream, ``speed`` times as fast as its events came (0: as fast as it can)."""
    spark.dataSource.register(Replay)
    r = spark.readStream.format(NAME).schema(schema).option("path", path).option("speed", str(speed))
    if pause_file:
        r = r.option("pauseFile", pause_file)
    return (r.option("maxSeconds", str(max_seconds)) if max_seconds else r).load()


def run_until_idle(query, idle_sec: float = 5.0, poll_sec: float = 0.2) -> None:
    """Stop a running query once it has had no new rows for ``idle_sec``; its error is raised."""
    last, rows, batch = time.monotonic(), 0, -1
    while query.isActive:
        p = query.lastProgress
        if p is not None and p["batchId"] != batch:
            batch, new = p["batchId"], p["numInputRows"]
            if new:
                last, rows = time.monotonic(), rows + new
        if time.monotonic() - last > idle_sec and not query.status["isTriggerActive"]:
            query.stop()
            break
        time.sleep(poll_sec)
    if query.exception():
        raise query.exception()
