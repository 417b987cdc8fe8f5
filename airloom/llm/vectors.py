"""Embedding near-duplicates by a robust-pruned flat graph over overlapping cluster shards."""

from __future__ import annotations

import logging

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, connected_components, local_components, table

LEAST_COSINE = 0.98
#: Two partners of one row are this near at least: twice the angle.
BRIDGE_COSINE = 2 * LEAST_COSINE**2 - 1
#: A shard with more rows is split again, by so many centroids at most, each fitted on about so many of its rows.
SHARD_ROWS, MOST_CENTROIDS, ROWS_PER_CENTROID, MOST_LEVELS = 1_000, 64, 32, 12
#: Rows that one task assigns to centroids.
ASSIGNED_ROWS = 20_000
CANDIDATES, DEGREE, ALPHA = 64, 24, 1.2
BEAM, QUERIES = 32, 256
#: The side of a block where all pairs are compared.
BLOCK_ROWS = 2_048
#: A query with more hits than this is compared with its whole shard, which finds no less and is faster.
DENSE = 128
#: Recall is audited on so many vectors of each label against all of it; a label below the least is done again with
#: shards that overlap more, and at last by comparing all its pairs.
AUDIT_ROWS, LEAST_RECALL, OVERLAPS = 64, 0.97, (2, 4)
#: With more poor labels than these all labels are done again, so that no longer list is needed.
MOST_POOR = 10_000
log = logging.getLogger(__name__)


def unit_vectors(raw: list[bytes], kind: str = "<f8") -> np.ndarray:
    """Rows of length one in double precision from vectors' bytes; ``kind`` is the type of their numbers."""
    x = np.frombuffer(b"".join(raw), kind).astype(np.float64).reshape(len(raw), -1)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def number_kind(vectors: DataFrame) -> str:
    """Single-precision vectors are carried as such, all others in double precision."""
    own = vectors.schema["embedding"].dataType
    return "<f4" if isinstance(own, T.ArrayType) and isinstance(own.elementType, T.FloatType) else "<f8"


def valid_rows(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, raw): the vector's bytes; null if the vector or label can't link."""
    kind = number_kind(vectors)

    def run(batches):
        for batch in batches:
            out = []
            for label, v in zip(batch.column("label").to_pylist(), batch.column("embedding").to_pylist()):
                ok = label is not None and bool(v) and None not in v
                x = np.array(v, np.float64) if ok else None
                fit = ok and np.isfinite(x).all() and 0 < x @ x < np.inf
                out.append(x.astype(kind).tobytes() if fit else None)
            cols = [batch.column("vec_id"), batch.column("label"), pa.array(out, pa.binary())]
            yield pa.record_batch(cols, names=["vec_id", "label", "raw"])

    own = [F.col("vec_id").cast("long"), F.col("label").cast("string"), F.col("embedding").cast("array<double>")]
    return vectors.select(*own).mapInArrow(run, "vec_id long, label string, raw binary")


def centroids(x: np.ndarray, k: int, steps: int = 10) -> np.ndarray:
    """Spherical k-means from evenly spaced rows of the sample."""
    c = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)]
    for _ in range(steps):
        near = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        norm = np.linalg.norm(sums, axis=1)
        c = np.where(norm[:, None] > 0, sums / np.maximum(norm, 1e-300)[:, None], c)
    return c


def shards(nodes: DataFrame, scratch: Scratch, kind: str, overlap: int) -> DataFrame:
    """(node, raw, shard, home): every node in the shard of its nearest centroid, its home, and beside it in others.

    A label's vectors of one length are a shard; a shard over SHARD_ROWS is split by centroids fitted on a
    sample of its own rows, and so on.  At each split a node at home goes to its ``overlap`` nearest centroids,
    a guest to its nearest, so a node has 1 + (overlap - 1) * levels shards at most.  Centroids are dealt to the tasks that assign a shard's rows, of which
    there are as many as the shard needs; nothing of this reaches the driver.
    """

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        c = centroids(unit_vectors(pdf.sort_values("raw").raw.tolist(), kind), int(pdf.k.iloc[0]))
        return pd.DataFrame({"shard": pdf.shard.iloc[0], "place": range(len(c)), "centre": [r.tobytes() for r in c]})

    def assign(rows: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(c):
            return pd.DataFrame({"node": [], "raw": [], "parent": [], "place": [], "home": []})
        c = c.sort_values("place")
        centres = np.frombuffer(b"".join(c.centre), np.float64).reshape(len(c), -1)
        sim = unit_vectors(rows.raw.tolist(), kind) @ centres.T
        near = np.argsort(-sim, axis=1, kind="stable")[:, :overlap]
        m = near.shape[1]
        home = rows.home.to_numpy(bool)
        rank = np.broadcast_to(np.arange(m), near.shape)
        goes = home[:, None] | (rank == 0)
        which = np.nonzero(goes)[0]
        return pd.DataFrame(
            {
                "node": rows.node.to_numpy()[which],
                "raw": rows.raw.to_numpy(object)[which],
                "parent": rows.shard.to_numpy()[which],
                "place": near[goes],
                "home": home[which] & (rank[goes] == 0),
            }
        )

    start = F.xxhash64("label", F.length("raw")).alias("shard")
    live, done = nodes.select("node", "raw", start, F.lit(True).alias("home")), []
    # a guest that meets its own node in a shard is one row there
    one = lambda d: d.groupBy("node", "shard").agg(F.first("raw").alias("raw"), F.max("home").alias("home"))
    for level in range(MOST_LEVELS):
        size = live.groupBy("shard").count().where(F.col("count") > SHARD_ROWS)
        wish = F.ceil(F.col("count") * (2 * overlap) / SHARD_ROWS)
        k = F.least(F.lit(MOST_CENTROIDS), F.greatest(F.lit(4 * overlap), wish)).cast("int").alias("k")
        big = scratch.keep(size.select("shard", "count", k), "big")
        if big.isEmpty():
            break
        done.append(live.join(big.select("shard"), "shard", "left_anti").select("node", "raw", "shard", "home"))
        part = live.join(big, "shard")
        draw = F.pmod(F.xxhash64("node", F.lit(level)), F.lit(1 << 30)) / float(1 << 30)
        sample = part.where(draw < F.col("k") * ROWS_PER_CENTROID / F.col("count")).select("shard", "raw", "k")
        centres = sample.groupBy("shard").applyInPandas(fit, "shard long, place int, centre binary")
        tasks = F.ceil(F.col("count") / ASSIGNED_ROWS).cast("int")
        salted = part.select(
            "node", "raw", "shard", "home", F.pmod(F.xxhash64("node"), tasks).cast("int").alias("salt")
        )
        dealt = centres.join(big.select("shard", tasks.alias("n")), "shard")
        dealt = dealt.select("shard", "place", "centre", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("salt"))
        both = salted.groupBy("shard", "salt").cogroup(dealt.groupBy("shard", "salt"))
        schema = "node long, raw binary, parent long, place int, home boolean"
        split = both.applyInPandas(assign, schema).withColumn("shard", F.xxhash64("parent", "place", F.lit(level)))
        live = scratch.keep(one(split).select("node", "raw", "shard", "home"), "shards")
    for part in done:
        live = live.unionByName(part)
    return live


def robust_prune(x: np.ndarray, degree: int = DEGREE) -> np.ndarray:
    """Neighbours of each row (-1: none): nearest first, leaving out whoever a chosen one is ALPHA times nearer to."""
    n = len(x)
    k = min(CANDIDATES, n - 1)
    out = np.full((n, degree), -1, np.int64)
    for a in range(0, n if k > 0 else 0, QUERIES):
        b = min(a + QUERIES, n)
        sim = x[a:b] @ x.T
        sim[np.arange(b - a), np.arange(a, b)] = -np.inf
        cand = np.argpartition(-sim, k - 1, axis=1)[:, :k]
        order = np.take_along_axis(sim, cand, 1).argsort(axis=1)[:, ::-1]
        cand = np.take_along_axis(cand, order, 1)
        far = 1 - np.take_along_axis(sim, cand, 1)
        alive = np.ones_like(cand, bool)
        rows = np.arange(b - a)
        for t in range(degree):
            pick = alive.argmax(axis=1)
            live = alive[rows, pick]
            if not live.any():
                break
            out[a:b, t] = np.where(live, cand[rows, pick], -1)
            between = 1 - np.einsum("nd,nkd->nk", x[cand[rows, pick]], x[cand])
            alive &= ALPHA * between > far
            alive[rows, pick] = False
    return out


def range_search(
    x: np.ndarray, graph: np.ndarray, start: int, queries: np.ndarray | None = None, least: float = LEAST_COSINE
):
    """For blocks of ``queries`` (row numbers, all by default): (row numbers, hits), hits marking rows at ``least`` or more.

    A beam search walks greedily from the medoid and the query's own row; then every hit's neighbours are
    looked at until no new hit comes.  A query with over DENSE hits is compared with all rows instead.
    """
    n = len(x)
    queries = np.arange(n) if queries is None else queries
    for a in range(0, len(queries), QUERIES):
        own = queries[a : a + QUERIES]
        q = x[own]
        m, rows = len(q), np.arange(len(q))
        seen, opened, hit = np.zeros((m, n), bool), np.zeros((m, n), bool), np.zeros((m, n), bool)
        ids, sim = np.full((m, BEAM), start), np.full((m, BEAM), -np.inf)
        sim[:, 0] = q @ x[start]
        seen[:, start] = True
        hit[:, start] = sim[:, 0] >= least
        other = own != start
        ids[other, 1], sim[other, 1] = own[other], 1.0
        seen[rows, own], hit[rows, own] = True, True
        done = np.isinf(sim)
        while not done.all():
            at = np.where(done, -np.inf, sim).argmax(axis=1)
            busy = ~done[rows, at]
            done[rows, at] = True
            r, node = rows[busy], ids[rows, at][busy]
            opened[r, node] = True
            near = graph[node]
            fresh = (near >= 0) & ~seen[r[:, None], near]
            s = np.where(fresh, np.einsum("nd,nkd->nk", q[r], x[near]), -np.inf)
            rr, kk = np.nonzero(fresh)
            seen[r[rr], near[rr, kk]] = True
            hit[r[rr], near[rr, kk]] |= s[rr, kk] >= least
            all_sim = np.concatenate([sim[r], s], axis=1)
            keep = np.argpartition(-all_sim, BEAM - 1, axis=1)[:, :BEAM]
            sim[r] = np.take_along_axis(all_sim, keep, 1)
            ids[r] = np.take_along_axis(np.concatenate([ids[r], near], axis=1), keep, 1)
            done[r] = np.take_along_axis(np.concatenate([done[r], ~fresh], axis=1), keep, 1)
        while True:
            wide = np.flatnonzero((hit.sum(axis=1) > DENSE) & ~opened.all(axis=1))
            if len(wide):
                hit[wide], opened[wide] = q[wide] @ x.T >= least, True
            r, node = np.nonzero(hit & ~opened)
            if not len(r):
                break
            opened[r, node] = True
            near = graph[node]
            ok = (near >= 0) & ~seen[r[:, None], near]
            rr = np.broadcast_to(r[:, None], near.shape)[ok]
            pair = np.unique(rr * n + near[ok])
            rr, nn = pair // n, pair % n
            seen[rr, nn] = True
            hit[rr, nn] = np.einsum("nd,nd->n", q[rr], x[nn]) >= least
        yield own, hit


def _graph_of(kind: str):
    """A shard's pruned graph as lists of edges in both directions, those to near rows apart as ``bridges``."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, ids = unit_vectors(pdf.raw.tolist(), kind), pdf.node.to_numpy(np.int64)
        near = robust_prune(x)
        back = [[] for _ in ids]
        for i, row in enumerate(near):
            for j in row[row >= 0]:
                back[j].append(i)
        lists, bridges = [], []
        for i, (row, b) in enumerate(zip(near, back)):
            own = np.unique(np.r_[row[row >= 0], np.array(b[:DEGREE], np.int64)])
            lists.append(ids[own].tolist())
            bridges.append(ids[own[x[own] @ x[i] >= BRIDGE_COSINE]].tolist())
        return pd.DataFrame({"node": ids, "near": lists, "bridges": bridges})

    return run


def _exact(nodes: DataFrame, scratch: Scratch, kind: str) -> DataFrame:
    """(node, pairs, links, root) from all pairs of a label, compared in blocks of bounded size."""
    size = nodes.groupBy("label", F.length("raw").alias("bytes")).count().withColumn(
        "n", F.ceil(F.col("count") / BLOCK_ROWS).cast("int")
    )
    dealt = nodes.withColumn("bytes", F.length("raw")).join(
        size.select("label", "bytes", "n"), ["label", "bytes"]
    )
    dealt = scratch.keep(
        dealt.select(
            "label", "bytes", "n", "node", "copies", "raw", F.pmod(F.xxhash64("node"), "n").cast("int").alias("own")
        ),
        "blocks",
    )
    every = F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other")
    asked = dealt.select("label", "bytes", "node", "raw", F.col("own").alias("i"), every.alias("j"))
    rows = dealt.select("label", "bytes", "node", "copies", "raw", F.col("own").alias("j"), every.alias("i"))

    def compare(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(r):
            return pd.DataFrame({"node": [], "pairs": [], "links": [], "root": []}).astype("int64")
        ids, own, copies = q.node.to_numpy(np.int64), r.node.to_numpy(np.int64), r.copies.to_numpy(np.int64)
        cosine = unit_vectors(q.raw.tolist(), kind) @ unit_vectors(r.raw.tolist(), kind).T
        hit = (cosine >= LEAST_COSINE) & (ids[:, None] != own[None, :])
        u, v = np.nonzero(hit)
        nodes, root = local_components(np.r_[ids[u], ids], np.r_[own[v], ids])
        to = pd.Series(root, index=nodes)
        count = pd.DataFrame({"node": ids, "pairs": hit.sum(axis=1), "links": hit @ copies, "root": to[ids].to_numpy()})
        there = np.setdiff1d(own[v], ids)
        return pd.concat(
            [count, pd.DataFrame({"node": there, "pairs": 0, "links": 0, "root": to[there].to_numpy()})]
        ).astype("int64")

    key = ["label", "bytes", "i", "j"]
    out = asked.groupBy(*key).cogroup(rows.groupBy(*key)).applyInPandas(
        compare, "node long, pairs long, links long, root long"
    )
    return scratch.keep(out, "links")


def _links_of(kind: str):
    """Links of a shard's home rows, found in the shard and its surroundings."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        ids, n = pdf.node.to_numpy(np.int64), len(pdf)
        x, copies = unit_vectors(pdf.raw.tolist(), kind), pdf.copies.to_numpy(np.int64)
        inside = []
        for near in pdf.near:
            near = np.asarray(near, np.int64)
            at = np.minimum(np.searchsorted(ids, near), n - 1)
            inside.append(at[ids[at] == near])
        graph = np.full((n, max([1, *map(len, inside)])), -1, np.int64)
        for i, near in enumerate(inside):
            graph[i, : len(near)] = near
        members = np.flatnonzero(pdf.member.to_numpy(bool))
        medoid = int(members[(x[members] @ x[members].mean(axis=0)).argmax()])
        queries, out, us, vs = np.flatnonzero(pdf.home.to_numpy(bool)), [], [], []
        for own, hit in range_search(x, graph, medoid, queries):
            hit[np.arange(len(own)), own] = False
            out.append(pd.DataFrame({"node": ids[own], "pairs": hit.sum(axis=1), "links": hit @ copies}))
            u, v = np.nonzero(hit)
            nodes, root = local_components(own[u], v)
            us.append(nodes)
            vs.append(root)
        if not out:
            return pd.DataFrame({"node": [], "pairs": [], "links": [], "root": []}).astype("int64")
        nodes, root = local_components(np.concatenate(us), np.concatenate(vs))
        to = pd.Series(ids[root], index=ids[nodes])
        count = pd.concat(out)
        count["root"] = to.reindex(count.node).fillna(pd.Series(count.node.to_numpy(), index=count.node)).to_numpy()
        there = np.setdiff1d(ids[nodes], count.node)
        rest = pd.DataFrame({"node": there, "pairs": 0, "links": 0, "root": to.reindex(there).to_numpy()})
        return pd.concat([count, rest]).astype("int64")

    return run


def _search(nodes: DataFrame, scratch: Scratch, kind: str, overlap: int) -> DataFrame:
    """(node, pairs, links, root): each node asks once, in its home shard.

    Shards' graphs are united by node.  A shard's search also has the rows that edges to near rows lead to
    from its members, with their own edges, so it follows the united graph beyond the shard.
    """
    dealt = scratch.keep(shards(nodes, scratch, kind, overlap), "members")
    graph = dealt.select("shard", "node", "raw").groupBy("shard")
    graph = graph.applyInPandas(_graph_of(kind), "node long, near array<long>, bridges array<long>")
    both = [F.array_distinct(F.flatten(F.collect_list(c))).alias(c) for c in ("near", "bridges")]
    united = scratch.keep(graph.groupBy("node").agg(*both), "graph")
    members = dealt.select("shard", "node", "home")
    reached = members.join(united.select("node", "bridges"), "node")
    reached = reached.select("shard", F.explode("bridges").alias("node")).distinct()
    around = reached.join(members.select("shard", "node"), ["shard", "node"], "left_anti")
    places = members.withColumn("member", F.lit(True)).unionByName(
        around.select("shard", "node", F.lit(False).alias("home"), F.lit(False).alias("member"))
    )
    known = nodes.select("node", "raw", "copies").join(united.select("node", "near"), "node")
    found = places.join(known, "node").groupBy("shard")
    found = found.applyInPandas(_links_of(kind), "node long, pairs long, links long, root long")
    return scratch.keep(found, "links")


def _recall(nodes: DataFrame, found: DataFrame, kind: str) -> dict[str, float]:
    """By label, the share found of the links that AUDIT_ROWS of its nodes (smallest hashes) have in all of it.

    Only labels below LEAST_RECALL are told, MOST_POOR + 1 of them at most.  A label's rows are compared in
    blocks, each with the nodes asked, so neither labels nor rows are gathered anywhere.
    """
    first = Window.partitionBy("label").orderBy(F.xxhash64("node", F.lit(7)), "node")
    asked = nodes.withColumn("__n", F.row_number().over(first)).where(F.col("__n") <= AUDIT_ROWS)
    asked = asked.select("label", F.length("raw").alias("bytes"), "node", "raw")
    asked = Scratch(nodes.sparkSession).keep(asked, "asked")
    blocks = nodes.groupBy("label", F.length("raw").alias("bytes")).agg(
        F.ceil(F.count("*") / ASSIGNED_ROWS).cast("int").alias("n")
    )
    every = F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("salt")
    dealt = asked.join(blocks, ["label", "bytes"]).select("label", "bytes", "node", "raw", every)
    rows = nodes.select("label", F.length("raw").alias("bytes"), "node", "raw").join(blocks, ["label", "bytes"])
    rows = rows.select("label", "bytes", "raw", F.pmod(F.xxhash64("node"), F.col("n")).cast("int").alias("salt"))

    def count(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(r):
            return pd.DataFrame({"node": [], "n": []}).astype("int64")
        x, total = unit_vectors(q.raw.tolist(), kind), np.zeros(len(q), np.int64)
        for a in range(0, len(r), BLOCK_ROWS):
            total += (x @ unit_vectors(r.raw.iloc[a : a + BLOCK_ROWS].tolist(), kind).T >= LEAST_COSINE).sum(axis=1)
        return pd.DataFrame({"node": q.node.to_numpy(np.int64), "n": total})

    key = ["label", "bytes", "salt"]
    exact = dealt.groupBy(*key).cogroup(rows.groupBy(*key)).applyInPandas(count, "node long, n long")
    exact = exact.groupBy("node").agg((F.sum("n") - 1).alias("n"))
    own = found.join(asked.select("node"), "node", "left_semi").groupBy("node").agg(F.sum("pairs").alias("pairs"))
    got = asked.select("label", "node").join(exact, "node").join(own, "node", "left")
    shares = got.groupBy("label").agg(
        F.sum("n").alias("n"), F.sum(F.least("n", F.coalesce("pairs", F.lit(0)))).alias("pairs")
    )
    poor = shares.where(F.col("pairs") < F.col("n") * LEAST_RECALL).limit(MOST_POOR + 1)
    return {r["label"]: r["pairs"] / r["n"] for r in poor.collect()}


def _found(nodes: DataFrame, scratch: Scratch, kind: str) -> DataFrame:
    """(node, pairs, links, root) of all nodes, with audited recall; the exact way for labels that stay below it."""
    done, left = [], nodes
    for overlap in OVERLAPS:
        found = _search(left, scratch, kind, overlap)
        recall = _recall(left, found, kind)
        poor = sorted(label for label, r in recall.items() if r < LEAST_RECALL)
        log.info("overlap %d: recall by label below %s: %s", overlap, LEAST_RECALL, recall)
        if not poor:
            return _union([*done, found])
        if len(poor) <= MOST_POOR:
            again = left.where(F.col("label").isin(poor))
            done.append(found.join(again.select("node"), "node", "left_anti"))
            left = again
    log.info("all pairs of %s", "the labels left" if done else "every label")
    return _union([*done, _exact(left, scratch, kind)])


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors`` (vec_id, embedding, label).

    Rows link at cosine LEAST_COSINE or more (in double precision, every link verified) if their labels
    are equal and not null and their vectors equally long.  Null, empty and zero vectors and those with
    null or non-finite components link with nothing.  Equal vectors of a label are one node with so
    many copies, so copies are not paired.  n_links is the number of other rows linked directly,
    component_id the smallest vec_id reachable, kept whether that is the row's own.  Rows that repeat
    a vec_id count each; a row without vec_id gets its component's smallest; no rows give no rows.

    Nodes go to the shards of their nearest centroids within their label.  Each shard gives a pruned graph;
    a node's edges are united over its shards; every node then searches from its home shard's medoid and
    its own row over the united graph (see ``_search``).  Recall is always audited and logged; where it is
    below LEAST_RECALL, all pairs of a label are compared in blocks at last.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    kind = number_kind(vectors)
    rows = scratch.keep(valid_rows(vectors), "rows")
    usable = rows.where("raw IS NOT NULL")
    nodes = usable.groupBy("label", "raw").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"))
    nodes = scratch.keep(nodes.withColumn("node", F.xxhash64("label", "raw")), "nodes")
    found = _found(nodes, scratch, kind)
    comp = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")), scratch)
    count = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = nodes.select("label", "raw", "node", "first", "copies", F.xxhash64("node").alias("name"))
    named = named.join(count, "node", "left")
    roots = comp.select(F.col("node").alias("name"), "root")
    named = named.join(roots, "name", "left").withColumn("root", F.coalesce("root", "name"))
    named = scratch.keep(named, "named")
    low = named.groupBy("root").agg(F.min("first").alias("component"))
    links = (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n")
    final = named.join(low, "root").select("label", "raw", "component", links)
    out = rows.join(final, ["label", "raw"], "left")
    component = F.when(F.col("raw").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    return out.select(
        "vec_id",
        F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )


def op6_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


OP6_SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0 AND len(list_filter(e,
  lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id
  AND len(a.e) = len(b.e)
      WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e)) / sqrt(list_dot_product(b.e,
      b.e)) >= {LEAST_COSINE}),
r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN c ON c.a = v.vec_id LEFT JOIN n ON n.a = v.vec_id
"""
