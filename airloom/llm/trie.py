"""Conversation prefix trie: Patricia construction over sorted sequences, unary nodes added afterwards."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordering import running
from ..staging import Scratch
from .common import frugal, partitions, table

#: Turns of a conversation that are compared as one sequence; a longer one goes on in a tree below.
BLOCK = 64
#: Turn numbers of a block when rows are numbered.
NUMBERED = 1024
#: Conversation ids in a piece of a node's list of ends.
ENDS = 4096

POINTS = (
    "depth long, p1 long, p2 long, up_depth long, up1 long, up2 long, tails array<long>, n long, low long, "
    "member_bytes long, node_bytes long, leaves long, children long, top boolean"
)


def share(conv_id: Column) -> Column:
    """How many first turns come from the conversation that ``donor`` names."""
    return F.crc32(conv_id.cast("string").cast("binary")) % 9


def donor(conv_id: Column) -> Column:
    return conv_id - conv_id % 5


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, digest, bytes): turns from 0, in order of turn (null first; ties: by digest of role and text)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("digest"),
        F.octet_length(text).cast("long").alias("bytes"),
    )
    block = F.coalesce(F.floor(F.col("turn") / NUMBERED), F.lit(-(1 << 62)))
    out = running(rows, "conv_id", block, ["turn", "digest"], F.lit(1), F.sum, frame="rows")
    return out.select("conv_id", F.col("running").alias("pos"), "digest", "bytes")


def rebuilt(turns: DataFrame) -> DataFrame:
    """``turns`` with each conversation's first ``share`` turns replaced by its donor's; pos is null without turns.

    A donor serves five conversations with eight turns at most.
    """
    ids = turns.groupBy("conv_id").agg(F.lit(None).cast("long").alias("pos"))
    c = F.col("conv_id")
    heads = turns.where((F.col("pos") < 8) & (c % 5 == 0)).withColumn("to", F.explode(F.sequence(c - 4, c + 4)))
    heads = heads.where((donor(F.col("to")) == c) & (F.col("pos") < share(F.col("to"))))
    heads = heads.select(F.col("to").alias("conv_id"), "pos", "digest", "bytes").join(ids, "conv_id", "left_semi")
    given = heads.groupBy("conv_id").agg(F.count("*").alias("given"))
    own = turns.where(F.col("pos") >= share(c)).join(given, "conv_id", "left")
    own = own.withColumn("pos", F.col("pos") - share(c) + F.coalesce("given", F.lit(0))).drop("given")
    return own.unionByName(heads).unionByName(ids, allowMissingColumns=True)


def sequences(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv_id, level, c1, c2, key, x1, x2, more, later): each conversation's blocks of ``block`` turns.

    A turn's hash covers its place, so the exclusive or of a path's hashes (c1, c2 before the block, with x1, x2
    behind it) names the path.  ``key`` has the block's (h1, h2, bytes); ``more`` says that blocks follow, and
    ``later`` how many bytes they have.
    """
    here = F.col("pos").isNotNull()
    h1, h2 = (F.when(here, F.xxhash64(F.lit(k), "pos", "digest")) for k in (1, 2))
    level = F.coalesce(F.expr(f"pos DIV {block}"), F.lit(0))
    rows = turns.select("conv_id", level.alias("level"), "pos", h1.alias("h1"), h2.alias("h2"), "bytes")
    blocks = rows.groupBy("conv_id", "level").agg(
        F.sort_array(F.collect_list(F.when(here, F.struct("pos", "h1", "h2", "bytes")))).alias("own"),
        F.coalesce(F.bit_xor("h1"), F.lit(0)).alias("x1"),
        F.coalesce(F.bit_xor("h2"), F.lit(0)).alias("x2"),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("size"),
    )
    w = Window.partitionBy("conv_id").orderBy("level")
    before, after = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    return blocks.select(
        "conv_id",
        "level",
        F.coalesce(F.bit_xor("x1").over(before), F.lit(0)).alias("c1"),
        F.coalesce(F.bit_xor("x2").over(before), F.lit(0)).alias("c2"),
        F.transform("own", lambda t: F.struct(t["h1"], t["h2"], t["bytes"])).alias("key"),
        "x1",
        "x2",
        F.lead("level").over(w).isNotNull().alias("more"),
        F.coalesce(F.sum("size").over(after), F.lit(0)).alias("later"),
    )


class Point:
    """An open point of the tree: sums over the members and nodes below it so far."""

    __slots__ = ("depth", "n", "low", "member_bytes", "node_bytes", "leaves", "children", "first", "end")

    def __init__(self, depth: int, first: bool, n=0, low=None, member_bytes=0, node_bytes=0, leaves=0, end=False):
        self.depth, self.first, self.n, self.low = depth, first, n, low
        self.member_bytes, self.node_bytes, self.leaves = member_bytes, node_bytes, leaves
        self.children, self.end = 0, end


def common(a: list, b: list) -> int:
    k = 0
    for x, y in zip(a, b):
        if x != y:
            break
        k += 1
    return k


class Patricia:
    """Points of the trees over one sorted run of distinct sequences, with a stack no deeper than a block.

    A branch point is where a sequence leaves the one before it, an end or leaf point is a sequence's last turn;
    turns between two points stay on the lower one's edge.  The run's first and last path may go on in the
    neighbouring runs (``before``: the last unit ahead of it, ``after``: the first behind it), so their edges are
    split into single nodes, whose sums over all runs can be added up; nodes that ``before`` has are counted there.
    """

    def __init__(self, before: tuple | None, after: tuple | None, block: int = BLOCK):
        self.before, self.after, self.block = before, after, block
        self.tree, self.path, self.sizes, self.names = None, [], [], []
        self.stack: list[Point] = []
        self.seen = 0

    def push(self, tree: tuple, path: list, sizes: list, sums: dict, more: int) -> Iterator[tuple]:
        first = self.tree is None
        if tree != self.tree:
            yield from self.close(False)
            if first and self.before and self.before[0] == tree:
                self.seen = common(self.before[1], path)
            self.tree, self.path = tree, []
            self.stack = [Point(0, first)]
        same = common(self.path, path)
        yield from self.unwind(same, False)
        self.path, self.sizes = path, sizes
        names = [tree[1:]]
        for h1, h2 in path:
            names.append((names[-1][0] ^ h1, names[-1][1] ^ h2))
        self.names = names
        if path:
            self.stack.append(Point(len(path), first))
        last = self.stack[-1]
        last.n, last.low, last.end = sums["n"], sums["low"], not more
        last.member_bytes, last.node_bytes, last.leaves = sums["later"], sums["rest_bytes"], sums["rest_leaves"]

    def close(self, final: bool = True) -> Iterator[tuple]:
        if self.tree is None:
            return
        goes_on = final and self.after is not None and self.after[0] == self.tree
        if goes_on and common(self.path, self.after[1]) == len(self.path):
            self.stack[-1].end = False  # the next run goes on below, so it isn't a leaf
        yield from self.unwind(-1, final)

    def unwind(self, to: int, split: bool) -> Iterator[tuple]:
        """Leave the points below depth ``to``, with a branch point there."""
        while self.stack and self.stack[-1].depth > to:
            x = self.stack.pop()
            if x.end and not x.children:
                x.leaves += 1
            if not x.depth:
                yield self.row(x, 0, 0, [0])
                return
            if self.stack[-1].depth < to:
                self.stack.append(Point(to, x.first))
            up = self.stack[-1]
            seen = self.seen if x.first else 0
            edge = self.sizes[up.depth : x.depth]
            fresh = [b if up.depth + i >= seen else 0 for i, b in enumerate(edge)]
            if split or x.first:
                for i in range(len(edge) - 1, -1, -1):
                    yield self.row(x, up.depth + i + 1, up.depth + i, edge[i : i + 1])
                    x.member_bytes += x.n * edge[i]
                    x.node_bytes += fresh[i]
                    x.children = int(up.depth + i >= seen)
                    x.depth -= 1
            else:
                tails, total = [], 0
                for b in reversed(edge):
                    total += b
                    tails.append(total)
                yield self.row(x, x.depth, up.depth, tails[::-1])
                x.member_bytes += x.n * total
                x.node_bytes += sum(fresh)
                x.children = int(up.depth >= seen)
            up.n += x.n
            up.low = x.low if up.low is None else min(up.low, x.low)
            up.member_bytes += x.member_bytes
            up.node_bytes += x.node_bytes
            up.leaves += x.leaves
            up.children += x.children

    def row(self, x: Point, depth: int, up: int, tails: list[int]) -> tuple:
        base = self.tree[0] * self.block
        above = (base + up, *self.names[up]) if depth else (None, None, None)
        sums = (x.n, x.low, x.member_bytes, x.node_bytes, x.leaves, x.children)
        return (base + depth, *self.names[depth], *above, tails, *sums, not depth)


def points(units: DataFrame, scratch: Scratch, block: int) -> DataFrame:
    """Points of the trees of all distinct sequences (level, c1, c2, key), one row for each run that has them."""
    spark, order = units.sparkSession, ["level", "c1", "c2", "key"]
    n = partitions(spark)
    ranged = units.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id())
    ranged = scratch.keep(ranged, "units")
    ends = ranged.groupBy("part").agg(F.min(F.struct(*order)).alias("a"), F.max(F.struct(*order)).alias("z"))
    bounds = sorted(ends.collect(), key=lambda r: r["part"])  # a row for each partition
    plain = lambda u: ((u["level"], u["c1"], u["c2"]), [(t["h1"], t["h2"]) for t in u["key"]])
    before = {b["part"]: plain(a["z"]) for a, b in zip(bounds, bounds[1:])}
    after = {a["part"]: plain(b["a"]) for a, b in zip(bounds, bounds[1:])}
    names = [f.split()[0] for f in POINTS.split(", ")]
    types = {"tails": pa.list_(pa.int64()), "top": pa.bool_()}
    schema = pa.schema([(c, types.get(c, pa.int64())) for c in names])

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    @frugal
    def run(batches):
        part, trees, rows = None, None, []
        for batch in batches:
            key = batch.column("key")
            offsets, flat = key.offsets.to_pylist(), key.values
            h1, h2, size = (flat.field(c).to_pylist() for c in range(3))
            hashes = list(zip(h1, h2))
            cols = {c: batch.column(c).to_pylist() for c in batch.schema.names if c != "key"}
            for i in range(len(batch)):
                if cols["part"][i] != part:
                    if trees:
                        rows.extend(trees.close())
                    part = cols["part"][i]
                    trees = Patricia(before.get(part), after.get(part), block)
                a, b = offsets[i], offsets[i + 1]
                tree = (cols["level"][i], cols["c1"][i], cols["c2"][i])
                sums = {c: cols[c][i] for c in ("n", "low", "later", "rest_bytes", "rest_leaves")}
                rows.extend(trees.push(tree, hashes[a:b], size[a:b], sums, cols["more"][i]))
                if len(rows) > 20_000:
                    yield batch_of(rows)
                    rows = []
        if trees:
            rows.extend(trees.close())
        if rows:
            yield batch_of(rows)

    return ranged.repartition(n, "part").sortWithinPartitions("part", *order).mapInArrow(run, POINTS)


def units_of(rows: DataFrame) -> DataFrame:
    """Distinct sequences with what their members have in common; copies end here, before anything is sorted."""
    return rows.groupBy("level", "c1", "c2", "key").agg(
        F.count("*").alias("n"),
        F.min("conv_id").alias("low"),
        F.sum("later").alias("later"),
        F.sum(F.col("more").cast("long")).alias("more"),
        F.sum("rest_bytes").alias("rest_bytes"),
        F.sum("rest_leaves").alias("rest_leaves"),
    )


def with_rest(rows: DataFrame, scratch: Scratch, block: int) -> DataFrame:
    """``rest_bytes`` and ``rest_leaves``: bytes and leaves of distinct nodes in the trees below, at one member of each.

    A tree's own sums go to its smallest member; a sum over the member's later blocks carries them to all trees
    above.
    """
    none = {c: F.lit(0).cast("long") for c in ("rest_bytes", "rest_leaves")}
    deep = rows.where("level > 0")
    if deep.isEmpty():
        return rows.withColumns(none)
    tops = points(units_of(deep.withColumns(none)), scratch, block).where("top")
    tops = tops.groupBy("depth", "p1", "p2").agg(
        F.min("low").alias("conv_id"), F.sum("node_bytes").alias("own"), F.sum("leaves").alias("own_leaves")
    )
    tops = tops.select(
        "conv_id",
        F.expr(f"depth DIV {block}").alias("level"),
        F.col("p1").alias("c1"),
        F.col("p2").alias("c2"),
        "own",
        "own_leaves",
    )
    after = Window.partitionBy("conv_id").orderBy("level").rowsBetween(1, Window.unboundedFollowing)
    rest = {"rest_bytes": "own", "rest_leaves": "own_leaves"}
    return (
        rows.join(tops, ["conv_id", "level", "c1", "c2"], "left")
        .withColumns({c: F.coalesce(F.sum(v).over(after), F.lit(0)) for c, v in rest.items()})
        .drop(*rest.values())
    )


def ends_digest(rows: DataFrame, block: int) -> DataFrame:
    """(depth, p1, p2, ends_sha256): SHA-256 of the ids of the conversations that end at a node.

    Ids are joined in pieces by ranges of ``ENDS`` ids before a task hashes a node's pieces one after the other.
    """
    end = rows.where("NOT more").select(
        (F.col("level") * block + F.size("key")).alias("depth"),
        F.col("c1").bitwiseXOR(F.col("x1")).alias("p1"),
        F.col("c2").bitwiseXOR(F.col("x2")).alias("p2"),
        "conv_id",
        F.floor(F.col("conv_id") / ENDS).alias("piece"),
    )
    ids = F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",")
    pieces = end.groupBy("depth", "p1", "p2", "piece").agg(ids.alias("ids"))
    order = ["depth", "p1", "p2", "piece"]

    def run(batches):
        node, digest = None, None
        for batch in batches:
            rows = []
            for d, p, q, ids in zip(*(batch.column(c).to_pylist() for c in ("depth", "p1", "p2", "ids"))):
                if (d, p, q) != node:
                    if node:
                        rows.append((*node, digest.hexdigest()))
                    node, digest = (d, p, q), hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            yield as_batch(rows)
        if node:
            yield as_batch([(*node, digest.hexdigest())])

    def as_batch(rows):
        cols = list(zip(*rows)) or [()] * 4
        kinds = [pa.int64()] * 3 + [pa.string()]
        return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], ["depth", "p1", "p2", "ends_sha256"])

    laid = pieces.repartition("depth", "p1", "p2").sortWithinPartitions(*order)
    return laid.mapInArrow(run, "depth long, p1 long, p2 long, ends_sha256 string")


def prefix_trie(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """Every node of the trie of conversations (conv_id, pos, digest, bytes; pos null: no turns), with its sums.

    Sequences of at most ``block`` turns are sorted; each range of the order becomes points of a compressed tree
    (see ``Patricia``), points that several ranges have are added up, and the unary nodes on a point's edge get
    their sums from the edge's suffix sums.  Longer conversations go on in a tree below the point where they leave
    off.  Columns as in the contract of ``op13``; no conversations give no nodes.
    """
    scratch = Scratch(turns.sparkSession)
    rows = scratch.keep(sequences(turns, block), "sequences")
    found = points(units_of(with_rest(rows, scratch, block)), scratch, block)
    deep_top = F.col("top") & (F.col("depth") > 0)  # known from the tree above, but for its children
    for c in ("n", "low", "member_bytes", "node_bytes", "leaves", "tails"):
        found = found.withColumn(c, F.when(~deep_top, F.col(c)))
    sums = [F.sum(c).alias(c) for c in ("n", "member_bytes", "node_bytes", "leaves", "children")]
    same = [F.max(c).alias(c) for c in ("up_depth", "up1", "up2", "tails")]
    nodes = scratch.keep(found.groupBy("depth", "p1", "p2").agg(F.min("low").alias("low"), *sums, *same), "points")
    above = nodes.select(
        F.col("depth").alias("up_depth"), F.col("p1").alias("up1"), F.col("p2").alias("up2"), F.col("low").alias("up_low")
    )
    full = nodes.join(above, ["up_depth", "up1", "up2"], "left").join(ends_digest(rows, block), ["depth", "p1", "p2"], "left")
    flat = full.select("*", F.size("tails").alias("k"), F.posexplode("tails").alias("i", "tail"))
    last = F.col("i") == F.col("k") - 1
    none = F.sha2(F.lit(""), 256)
    return flat.select(
        F.col("low").alias("conv_id"),
        (F.col("depth") - F.col("k") + 1 + F.col("i")).alias("depth"),
        F.when(F.col("i") > 0, F.col("low")).otherwise(F.col("up_low")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.when(last, F.col("children")).otherwise(F.lit(1)).alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        (F.col("member_bytes") - F.col("node_bytes") + (F.col("n") - 1) * F.col("tail")).alias("saved_tokens"),
        F.when(last, F.coalesce("ends_sha256", none)).otherwise(none).alias("ends_sha256"),
    )


def op13_prefix_trie(spark, sf_dir: str) -> DataFrame:
    """Rows without a conv_id belong to no conversation; null roles and texts are empty; repeated rows are turns."""
    return prefix_trie(rebuilt(numbered(table(spark, sf_dir, "conversations"))))


_crc32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, [ascii(ch)::BIGINT FOR ch IN string_split(c::VARCHAR, '')]),
  lambda v, b: list_reduce(list_prepend(xor(v, b), range(8)),
    lambda w, k: CASE WHEN w % 2 = 1 THEN xor(w // 2, 3988292384) ELSE w // 2 END)), 4294967295)"""
OP13_SQL = f"""
WITH a AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           WHERE conv_id IS NOT NULL),
b AS (SELECT conv_id, md5(length(role) || ':' || role || text) AS digest, strlen(text) AS bytes, turn FROM a),
t AS (SELECT conv_id, digest, bytes,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) - 1 AS pos FROM b),
i AS (SELECT c, {_crc32} % 9 AS h FROM (SELECT DISTINCT conv_id AS c FROM t)),
r AS (SELECT c, pos, digest, bytes FROM i JOIN t ON t.conv_id = c - c % 5 AND pos < h
      UNION ALL SELECT c, pos, digest, bytes FROM i JOIN t ON t.conv_id = c AND pos >= h),
s AS (SELECT c, bytes, row_number() OVER w AS depth, md5(string_agg(digest, '') OVER w) AS node FROM r
      WINDOW w AS (PARTITION BY c ORDER BY pos ROWS UNBOUNDED PRECEDING)),
m AS (SELECT c, depth, node, lag(node, 1, '') OVER (PARTITION BY c ORDER BY depth) AS up, bytes FROM s
      UNION ALL SELECT c, 0, '', NULL, 0 FROM i),
e AS (SELECT c, arg_max(node, depth) AS node FROM m GROUP BY c),
x AS (SELECT node, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS ends FROM e GROUP BY node),
n AS (SELECT node, any_value(depth) AS depth, any_value(up) AS up, min(c) AS low, count(*) AS n,
        any_value(bytes) AS bytes FROM m GROUP BY node),
k AS (SELECT up AS node, count(*) AS children FROM n WHERE up IS NOT NULL GROUP BY up),
u AS (SELECT m.node, sum((n.n - 1) * n.bytes) AS saved, count(*) FILTER (k.children IS NULL) AS leaves
      FROM n LEFT JOIN k ON k.node = n.node JOIN m ON m.c = n.low AND m.depth <= n.depth GROUP BY m.node)
SELECT n.low AS conv_id, n.depth::BIGINT AS depth, p.low AS parent_conv_id, n.n AS n_convs,
       coalesce(k.children, 0) AS n_children, u.leaves AS n_leaves, u.saved::BIGINT AS saved_tokens,
       coalesce(x.ends, sha256('')) AS ends_sha256
FROM n JOIN u ON u.node = n.node LEFT JOIN k ON k.node = n.node LEFT JOIN x ON x.node = n.node
  LEFT JOIN n p ON p.node = n.up
"""
