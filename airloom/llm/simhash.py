"""SimHash near-duplicates by meet-in-the-middle ball hashing."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, connected_components, frugal, local_components, partitions, table, text_batches

RADIUS = 3
BLOCKS, WIDTH = 4, 16
REST = 64 - WIDTH
ROWS_PER_TASK = 500_000
#: A task that explodes fingerprints fills so many of the tasks that link them.
SPREAD = 4
DENSE = 32
_NEAR = {
    d: np.array([sum(1 << i for i in c) for c in itertools.combinations(range(WIDTH), d)], np.int64) for d in (1, 2, 3)
}


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Unsigned 64-bit SimHash of one text; null or wordless texts give 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    norm = b" ".join(words)
    if len(words) <= shingle:
        hashes = np.array([xxhash.xxh64_intdigest(norm, 42)], np.uint64)
    else:
        length = np.fromiter(map(len, words), np.int64, len(words))
        end = np.cumsum(length + 1) - 1
        start = (end - length)[: len(words) - shingle + 1].tolist()
        h = xxhash.xxh64_intdigest
        hashes = np.fromiter(
            (h(norm[s:e], 42) for s, e in zip(start, end[shingle - 1 :].tolist())), np.uint64, len(start)
        )
    count = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):
        part = hashes[at : at + 8192]
        count += np.unpackbits(
            part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little"
        ).sum(axis=0, dtype=np.int64)
    bits = (2 * count > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id long, fp long) for every row of ``docs`` (doc_id, text); whole texts, no shuffle."""

    @frugal
    def run(batches):
        for batch in batches:
            fps = [fingerprint(t.as_py(), shingle) for t in batch.column("text")]
            yield pa.record_batch(
                {"doc_id": batch.column("doc_id"), "fp": pa.array(np.array(fps, np.uint64).view(np.int64))}
            )

    return docs.select(
        F.col("doc_id").cast("long"), F.col("text").cast("string")
    ).mapInArrow(run, "doc_id long, fp long")


def _dense_links(fp: np.ndarray, key: int, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what a large bucket connects, in time linear in its size.

    Outside the block every member is within one bit of the key, so two members with equal block
    values differ in at most two bits.  Block values one bit apart always link; two apart if one
    member equals the key; three apart if both do.  Pairs whose outer bits agree but differ from the
    key meet again in the bucket of their own outer bits.
    """
    inner = (fp.view(np.uint64) >> np.uint64(WIDTH * block)).astype(np.int64) & (2**WIDTH - 1)
    own = _outer(fp, block) == key
    values, first, inv = np.unique(inner, return_index=True, return_inverse=True)
    u, v = [fp], [fp[first][inv]]
    own_values, own_first = np.unique(inner[own], return_index=True)
    own_fp = fp[own][own_first]

    def look(of: np.ndarray, of_fp: np.ndarray, among: np.ndarray, among_fp: np.ndarray, masks: np.ndarray) -> None:
        for m in masks.tolist():
            at = np.minimum(np.searchsorted(among, of ^ m), len(among) - 1)
            hit = among[at] == of ^ m
            u.append(of_fp[hit])
            v.append(among_fp[at][hit])

    look(values, fp[first], values, fp[first], _NEAR[1])
    if len(own_values):
        look(own_values, own_fp, values, fp[first], _NEAR[2])
        look(own_values, own_fp, own_values, own_fp, _NEAR[3])
    return np.concatenate(u), np.concatenate(v)


def _outer(fp: np.ndarray, block: int) -> np.ndarray:
    """The bits outside a block, closed up to 48 bits."""
    x = fp.view(np.uint64)
    low = x & np.uint64((1 << (WIDTH * block)) - 1)
    high = (x >> np.uint64(WIDTH * block + WIDTH - 1)) >> np.uint64(1)
    return ((high << np.uint64(WIDTH * block)) | low).astype(np.int64)


def bucket_links(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links at RADIUS or fewer bits among fingerprints that share a key; ``key`` holds the block above bit 48."""
    order = np.argsort(key, kind="stable")
    key, fp = key[order], fp[order]
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[start, len(key)])
    u, v = [], []
    for gap in range(1, DENSE):
        at = np.concatenate(
            [
                start[size == s][:, None] + np.arange(s - gap) for s in range(gap + 1, DENSE + 1) if (size == s).any()
            ] or [np.zeros((0, 1), np.int64)],
            axis=None,
        ).astype(np.int64)
        if len(at):
            near = np.bitwise_count((fp[at] ^ fp[at + gap]).view(np.uint64)) <= RADIUS
            u.append(fp[at[near]])
            v.append(fp[at[near] + gap])
    for s, n in zip(start[size > DENSE].tolist(), size[size > DENSE].tolist()):
        x, y = _dense_links(np.unique(fp[s : s + n]), int(key[s]) & (2**REST - 1), int(key[s]) >> REST)
        u.append(x)
        v.append(y)
    return np.concatenate(u or [fp[:0]]), np.concatenate(v or [fp[:0]])


def ball_links(fps: DataFrame, n_fps: int) -> DataFrame:
    """(a, b) links that connect all fingerprints at RADIUS or fewer differing bits.

    Half of a radius of 3 would round up to balls of two bits, 2,081 variants each.  Instead one of
    four 16-bit blocks is left out in turn: of three differing bits at least one lies in some block,
    so outside it at most two differ and two balls of one bit meet: 4 x 49 variants.  A variant's key
    is the block and the other 48 bits.  Keys are dealt by hash, and every meeting pair is verified on
    all 64 bits.  A bucket's size has a bound of its own (49 x 65,536 distinct fingerprints).
    """
    keys = []
    for b in range(BLOCKS):
        low = F.col("fp").bitwiseAND(F.lit((1 << (WIDTH * b)) - 1))
        high = F.shiftleft(F.shiftrightunsigned(F.shiftrightunsigned("fp", WIDTH * b + WIDTH - 1), 1), WIDTH * b)
        outer = low.bitwiseOR(high).bitwiseOR(F.lit(b << REST))
        keys += [outer] + [outer.bitwiseXOR(F.lit(1 << j)) for j in range(REST)]
    n = max(partitions(fps.sparkSession), -(-n_fps * len(keys) // ROWS_PER_TASK))
    # spread before the explosion: the table of fingerprints is small, that of its keys isn't
    dealt = fps.repartition(-(-n // SPREAD)).select("fp", F.explode(F.array(*keys)).alias("key")).repartition(n, "key")

    @frugal
    def run(batches):
        got = [(b.column("key").to_numpy(), b.column("fp").to_numpy()) for b in batches]
        if got:
            key, fp = (np.concatenate(x) for x in zip(*got))
            u, v = bucket_links(key, fp)
            nodes, root = local_components(u, v)
            far = nodes != root
            yield pa.record_batch({"a": pa.array(nodes[far]), "b": pa.array(root[far])})

    return dealt.select("key", "fp").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs`` (doc_id, text; more columns are ignored).

    Texts are lower-cased (A-Z), cut into words at white space and into shingles of ``shingle`` words,
    repeats included; a fingerprint bit is set if over half of the shingles' XXH64 have it.  Fingerprints
    at three or fewer differing bits link; component_id is the smallest doc_id reachable.  Null, empty
    and wordless texts have fingerprint zero and link like others.  Equal fingerprints are one node, so
    copies, ties and repeated rows cost nothing more.  A row without doc_id gets its component's
    smallest doc_id, or null.  An empty table gives an empty result.
    """
    text_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession)
    each = scratch.keep(fingerprints(docs, shingle), "fp")
    fps = scratch.keep(each.groupBy("fp").agg(F.min("doc_id").alias("first")), "fps")
    links = ball_links(fps.select("fp"), fps.count())
    comp = connected_components(links, scratch)
    named = fps.select("fp", "first", F.xxhash64("fp").alias("node")).join(comp, "node", "left")
    named = scratch.keep(named.select("fp", "first", F.coalesce("root", "node").alias("root")), "named")
    low = named.groupBy("root").agg(F.min("first").alias("component_id"))
    final = named.join(low, "root").select("fp", "component_id")
    scratch.drop(fps)
    out = each.join(final, "fp")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """Documents without all but one of each near-duplicate group (the smallest doc_id stays).

    Rows without a doc_id stay; of rows that repeat a doc_id one stays."""
    kept = near_duplicates(docs, shingle).where("doc_id = component_id").select("doc_id").distinct()
    named = docs.where("doc_id IS NOT NULL").join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return named.select(docs.columns).unionByName(docs.where("doc_id IS NULL"))


def op1_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
