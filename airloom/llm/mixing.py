"""Mixing sources to target weights by min-cost flow over membership patterns."""

from __future__ import annotations

import json
import math
from collections import deque
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, table

WORD = r"[^\x20\x09-\x0D]+"
MOST_REPEATS = 3
SEED = 17
#: Documents of a pattern are ordered by a seeded 60-bit hash, of which the leading bits give buckets: at least this
#: many bits, and so many that a bucket has some ROWS_PER_BUCKET rows, up to the other bound.
HASH_BITS, LEAST_BITS, MOST_BITS, ROWS_PER_BUCKET = 60, 12, 24, 2_000
#: The driver solves the flow over the patterns; more distinct ones than this raise an error.
MOST_PATTERNS = 100_000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(doc_id: Column, seed: int = SEED) -> Column:
    """A seeded 60-bit hash of doc_id that any engine with MD5 can give."""
    text = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def targets(sizes: dict, weights: dict, repeats: int = MOST_REPEATS) -> dict:
    """Each source's share of all words by weight, at most ``repeats`` times its size; the excess is shared again by weight."""
    total, capped, free = sum(sizes.values()), 0, sum(weights.values())
    out = {}
    for s in sorted(sizes, key=lambda s: (repeats * sizes[s] / weights[s], str(s))):
        share = (total - capped) * weights[s] / free
        if share >= repeats * sizes[s]:
            out[s] = float(repeats * sizes[s])
            capped += repeats * sizes[s]
            free -= weights[s]
        else:
            break
    return {s: out.get(s, (total - capped) * weights[s] / free if free else 0.0) for s in sizes}


def min_cost_flow(
    sizes: list[int], members: list[tuple[int, ...]], quotas: list[int], repeats: int = MOST_REPEATS
) -> list[int]:
    """Words to take from each pattern so that quotas are met as far as possible at least cost.

    The r-th reading of a pattern's words costs r each, so repetition is spread before it deepens.
    Arcs: start to pattern (one per reading), pattern to each of its sources, source to end.  Each
    augmentation takes a cheapest path (label-correcting search), so the flow stays a cheapest one.
    """
    p, start, end = len(sizes), len(sizes) + len(quotas), len(sizes) + len(quotas) + 1
    to, cap, cost, out = [], [], [], [[] for _ in range(end + 1)]

    def arc(a, b, c, w):
        for x, y, z, v in ((a, b, c, w), (b, a, 0, -w)):
            out[x].append(len(to))
            to.append(y)
            cap.append(z)
            cost.append(v)

    for i, size in enumerate(sizes):
        for r in range(repeats):
            arc(start, i, size, r + 1)
        for s in members[i]:
            arc(i, p + s, repeats * size, 0)
    for s, q in enumerate(quotas):
        arc(p + s, end, q, 0)
    while True:
        dist, via, queue, queued = [float("inf")] * (end + 1), [-1] * (end + 1), deque([start]), [False] * (end + 1)
        dist[start] = 0
        while queue:
            x = queue.popleft()
            queued[x] = False
            for e in out[x]:
                if cap[e] > 0 and dist[x] + cost[e] < dist[to[e]]:
                    dist[to[e]], via[to[e]] = dist[x] + cost[e], e
                    if not queued[to[e]]:
                        queue.append(to[e])
                        queued[to[e]] = True
        if dist[end] == float("inf"):
            break
        path, x = [], end
        while x != start:
            path.append(via[x])
            x = to[via[x] ^ 1]
        amount = min(cap[e] for e in path)
        for e in path:
            cap[e] -= amount
            cap[e ^ 1] += amount
    return [sum(cap[e ^ 1] for e in out[i] if not e % 2) for i in range(p)]


def _mixed(
    docs: DataFrame, sources: Column, size: Column, seed: int, repeats: int, weight: Callable[[int], int]
) -> tuple[DataFrame, dict, dict]:
    """``docs`` with the struct ``__mix`` (size, pattern, taken), and each source's size and target.

    Columns of this function's own start with two underscores, so other names may clash with none.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    member = F.array_sort(F.array_distinct(sources))
    own = {"__size": size, "__pattern": F.to_json(member), "__h": draw(F.col("doc_id"), seed)}
    marked = docs.withColumns(own).withColumn("__doc", F.col("doc_id").cast("long"))
    narrow = scratch.keep(marked.select("__doc", "__pattern", "__size", "__h"), "sizes")
    totals = [F.sum("__size").alias("size"), F.count("*").alias("rows")]
    sums = narrow.groupBy("__pattern").agg(*totals).limit(MOST_PATTERNS + 1).collect()
    if len(sums) > MOST_PATTERNS:
        raise ValueError(f"over {MOST_PATTERNS} membership patterns")
    found = [
        {"pattern": r["__pattern"], "size": r["size"], "sources": json.loads(r["__pattern"] or "[]")} for r in sums
    ]
    found = sorted((r for r in found if r["sources"]), key=lambda r: r["pattern"])
    names = sorted({s for r in found for s in r["sources"]}, key=lambda s: (s is None, s or ""))
    sizes = {s: sum(r["size"] for r in found if s in r["sources"]) for s in names}
    total = sum(r["size"] for r in found)
    weights = {s: weight(i) for i, s in enumerate(names)}
    goal = targets(sizes, weights, repeats) if total else {s: 0.0 for s in names}
    place = {s: i for i, s in enumerate(names)}
    members = [tuple(place[s] for s in r["sources"]) for r in found]
    flow = min_cost_flow([r["size"] for r in found], members, [int(goal[s] + 0.5) for s in names], repeats)
    plan = [(r["pattern"], *(divmod(a, r["size"]) if r["size"] else (0, 0))) for r, a in zip(found, flow)]
    plan = spark.createDataFrame(plan, "__pattern string, __passes long, __rest long")

    rows = max((r["rows"] for r in sums), default=0)
    bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(1, rows / ROWS_PER_BUCKET)))))
    bucket = F.shiftright("__h", HASH_BITS - bits).cast("int")
    marked, narrow = marked.withColumn("__bucket", bucket), narrow.withColumn("__bucket", bucket)
    by_bucket = narrow.groupBy("__pattern", "__bucket").agg(F.sum("__size").alias("s"))
    before = "sum(s) OVER (PARTITION BY __pattern ORDER BY __bucket) - s AS __at"
    run = by_bucket.selectExpr("__pattern", "__bucket AS __edge", "s", before)
    edge = run.join(F.broadcast(plan), "__pattern").where("__at <= __rest AND __at + s > __rest")
    edge = plan.join(edge.select("__pattern", "__edge", "__at"), "__pattern", "left")
    edge = scratch.keep(edge.coalesce(1), "edge")
    last = narrow.join(F.broadcast(edge), "__pattern").where("__bucket = __edge")
    last = last.groupBy("__pattern", "__doc", "__size", "__h", "__rest", "__at").agg(F.count("*").alias("n"))
    order = "(PARTITION BY __pattern ORDER BY __h, __doc, __size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    last = last.selectExpr("*", f"__at + sum(__size * n) OVER {order} - __size * n AS before")
    share = F.least(F.col("__rest") - F.col("before"), F.col("__size") * F.col("n"))
    part = F.floor(F.greatest(F.lit(0), share) / F.col("n")).alias("__part")
    names_of = {"__pattern": "__p", "__doc": "__d", "__size": "__s"}
    last = last.select(*[F.col(c).alias(n) for c, n in names_of.items()], part).where("__part > 0")
    last = scratch.keep(last, "last")
    out = marked.join(F.broadcast(edge), "__pattern", "left")
    same = (F.col("__pattern") == F.col("__p")) & F.col("__doc").eqNullSafe(F.col("__d"))
    at_edge = (F.col("__size") == F.col("__s")) & (F.col("__bucket") == F.col("__edge"))
    out = out.join(last, same & at_edge, "left")
    first = F.col("__bucket") < F.coalesce("__edge", F.lit(1 << bits))
    whole = F.when(F.col("__rest") > 0, F.col("__size")).otherwise(0)
    more = F.when(first, whole).otherwise(F.coalesce("__part", F.lit(0)))
    taken = F.coalesce(F.col("__passes") * F.col("__size") + more, F.lit(0)).cast("long")
    mix = F.struct(F.col("__size").alias("size"), F.col("__pattern").alias("pattern"), taken.alias("taken"))
    return out.select(*[F.col(c) for c in docs.columns], mix.alias("__mix")), sizes, goal


def mix(
    docs: DataFrame,
    sources: Column,
    seed: int = SEED,
    repeats: int = MOST_REPEATS,
    weight: Callable[[int], int] = lambda i: 1 + i % 3,
    size: Column | None = None,
) -> tuple[DataFrame, dict, dict]:
    """``docs`` (doc_id, text, ...) with size, pattern and taken, and each source's size and target.

    ``sources`` is the array of the sources a row belongs to; a document may belong to several, and
    then counts in each one's size.  The i-th source by code point (null last) weighs ``weight(i)``.
    size is the number of words (null text: 0) or what ``size`` says; taken the words that the mix takes, at
    most ``repeats`` times size.  Documents are summed by membership pattern; the flow gives each pattern's
    words; within a pattern all documents are read equally often, and those first by the seeded hash
    once more, the last of them in part.

    Rows that repeat a doc_id with one size share what falls to them; texts of any length count as they
    are; an empty table gives an empty result; rows without source are not taken.  Columns named size, pattern
    or taken are replaced, all others pass under any name that doesn't start with two underscores.
    """
    size = words(F.col("text").cast("string")) if size is None else size
    out, sizes, goal = _mixed(docs, sources, size, seed, repeats, weight)
    kept = [F.col(c) for c in docs.columns if c not in ("size", "pattern", "taken")]
    return out.select(*kept, "__mix.*"), sizes, goal


def mixed_documents(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """``docs`` with each row as often as the mix reads it; one read by at least half counts as read whole."""
    size = words(F.col("text").cast("string"))
    out, _, _ = _mixed(docs, F.array("source"), size, seed, MOST_REPEATS, lambda i: 1 + i % 3)
    own, taken = F.col("__mix.size"), F.col("__mix.taken")
    times = F.when(own > 0, F.floor(taken / own + 0.5)).otherwise(0).cast("int")
    out = out.withColumn("__times", times).where("__times > 0")
    out = out.withColumn("__time", F.explode(F.sequence(F.lit(1), F.col("__times"))))
    return out.select(docs.columns)


def op7_source_mixing(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", words(F.col("text")).alias("size"))
    docs = Scratch(spark).keep(docs, "words")  # texts are read once
    out, sizes, goal = mix(docs, F.array("source"), size=F.col("size"))
    known = [(s, n, goal[s]) for s, n in sizes.items()]
    known = spark.createDataFrame(known, "name string, source_size long, target double")
    out = out.join(F.broadcast(known), F.col("source").eqNullSafe(F.col("name")))
    return out.select("doc_id", "size", "source_size", "target", "taken")


OP7_SQL = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                  CAST('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':{SEED}'), 1, 15) AS BIGINT) AS h
                  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS size FROM d GROUP BY source),
w AS (SELECT *, 1 + (row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1) % 3 AS w FROM s),
c AS (SELECT *, sum(size) OVER () AS total,
  coalesce(sum({MOST_REPEATS} * size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
             sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free, row_number() OVER o AS k
      FROM w WINDOW o AS (ORDER BY {MOST_REPEATS} * size / w, source)),
f AS (SELECT arg_min(total - capped, k) AS rest, arg_min(free, k) AS free, min(k) AS k FROM c
  WHERE (total - capped) * w / free < {MOST_REPEATS} * size),
t AS (SELECT c.source, c.size AS source_size, CASE WHEN f.k IS NULL OR c.k < f.k
  THEN CAST({MOST_REPEATS} * c.size AS DOUBLE)
  ELSE CAST(f.rest * c.w AS DOUBLE) / CAST(f.free AS DOUBLE) END AS target FROM c LEFT JOIN f ON true),
q AS (SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS quota FROM t),
r AS (SELECT d.doc_id, d.size, q.source_size, q.target, CASE WHEN q.source_size > 0 THEN quota // q.source_size
  ELSE 0 END AS passes,
             CASE WHEN q.source_size > 0 THEN quota % q.source_size ELSE 0 END AS rest,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING
             AND CURRENT ROW) - d.size AS before
      FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, source_size::BIGINT AS source_size, target, (passes * size + greatest(0, least(size,
  rest - before)))::BIGINT AS taken FROM r
"""
