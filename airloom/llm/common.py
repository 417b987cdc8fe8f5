"""Shared parts: batches, memory and connected components."""

from __future__ import annotations

import ctypes
import functools
import gc

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import Scratch

def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def release_memory() -> None:
    """Give freed memory back to the system: a worker outlives its task, and the next may run beside it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def frugal(run):
    """A batch function that releases memory when it ends."""

    @functools.wraps(run)
    def wrapped(batches):
        yield from run(batches)
        release_memory()

    return wrapped


def text_batches(spark: SparkSession, rows: int = 2_000) -> None:
    """Smaller Arrow batches for operators that pass whole texts to Python, unless the session sets its own.

    Results are computed after the operator returns, so the setting stays for the session.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if key not in spark.conf.getAll:
        spark.conf.set(key, str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def local_components(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the undirected edges (u, v), and the smallest node of each one's component."""
    nodes, idx = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = idx[: len(u)], idx[len(u) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        new = np.minimum(new, new[root])
        if np.array_equal(new, root):
            return nodes, nodes[root]
        root = new


def connected_components(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of the undirected edges; equal roots mean one component.

    Nodes are renamed by xxhash64, which is a bijection on longs, so the smallest name is a random
    pick.  A round maps each node to the smallest name within two steps and contracts the graph by
    that map; components of radius two are done after one round, and a path of n nodes shrinks by a
    constant factor.  Every step is a partial aggregate or an equi-join that adaptive execution may
    split, so a node with very many links does not gather in one task.  ``root`` is a renamed node.
    """
    name = lambda c: F.xxhash64(F.col(c).cast("long"))
    raw = edges.select(name(a).alias("u"), name(b).alias("v")).where("u <> v")
    live = scratch.keep(raw.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    steps: list[DataFrame] = []
    while not live.isEmpty():
        both = live.unionByName(live.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("p"))
        near = scratch.keep(near, "near")
        two = both.join(
            near.select(F.col("u").alias("v"), F.col("p").alias("q")), "v"
        ).groupBy("u").agg(F.min("q").alias("q"))
        step = scratch.keep(two.select("u", F.least("u", "q").alias("root")), "step")
        left = step.select("u", F.col("root").alias("ru"))
        right = step.select(F.col("u").alias("v"), F.col("root").alias("rv"))
        joined = live.join(left, "u").join(right, "v").where("ru <> rv")
        nxt = scratch.keep(
            joined.select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct(), "edges"
        )
        scratch.drop(live, near)
        steps.append(step)
        live = nxt
    if not steps:
        return live.select(F.col("u").alias("node"), F.col("v").alias("root"))
    out = steps[0]
    for step in steps[1:]:
        more = step.select(F.col("u").alias("root"), F.col("root").alias("r2"))
        out = out.join(more, "root", "left").select("u", F.coalesce("r2", "root").alias("root"))
    return out.select(F.col("u").alias("node"), "root")
