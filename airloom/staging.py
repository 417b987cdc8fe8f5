"""Tables in the checkpoint folder, which cut lineage and outlive executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_roots: dict[str, str] = {}
_written: dict[str, tuple] = {}


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder in ``spark.checkpoint.dir``; a temporary one only where it is unset (tests)."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own_roots:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        _own_roots[app] = "file://" + tempfile.mkdtemp(prefix="airloom-")
    return _own_roots[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the root; ``clean`` and the end of the driver remove it."""
    path = f"{checkpoint_root(spark)}/airloom-{name}-{uuid.uuid4().hex}"
    _written[path] = (spark._jvm, spark._jsc.hadoopConfiguration())
    return path


def remove(path: str) -> None:
    jvm, conf = _written.pop(path, (None, None))
    if jvm is not None:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


@atexit.register
def clean() -> None:
    """Remove every table that is still there; results that read one must have been used before."""
    for path in list(_written):
        try:
            remove(path)
        except Exception:  # the JVM may have ended before  # noqa: BLE001
            _written.pop(path, None)


class Scratch:
    """Tables written to the checkpoint folder: they cut lineage and survive the loss of an executor.

    ``keep`` writes a DataFrame and returns it read again; ``drop`` deletes what later steps no longer read.
    A table that a returned DataFrame reads stays until ``clean``, which runs at the end of the driver.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = new_path(self.spark, name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (path, out)
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            path, _ = self.paths.pop(id(t), (None, None))
            if path:
                remove(path)
