"""Ranked lexical search: Block-Max WAND over shards of an inverted index."""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..staging import Scratch
from .common import frugal, table, text_batches

#: A shard ends after the document that brings it to so many terms or documents.
SHARD_TERMS = 3_000_000
SHARD_DOCS = 65_536
#: Postings of a block; the last one of a list may have fewer.
BLOCK = 128
#: Items searched by one job; more are searched in turn.
ITEMS_AT_ONCE = 1_000
#: Bytes of a text that are split at once.
PIECE = 1 << 22

#: UTF-8 with A-Z lowered and every other ASCII byte but letters and digits as a blank.
_SPACED = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)

INDEX = (
    "doc_ids array<long>, lens binary, names binary, name_ends binary, dfs binary, lasts binary, widths binary, "
    "pair_counts binary, pair_tfs binary, pair_lens binary, postings binary"
)
FOUND = pa.schema([("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])


def split_terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, piece by piece, so that a very long one needs no list of all."""
    spaced = text.translate(_SPACED)
    at = 0
    while at < len(spaced):
        end = at + PIECE
        end = len(spaced) if end >= len(spaced) else spaced.find(b" ", end) + 1 or len(spaced)
        yield spaced[at:end].split()
        at = end


class ShardBuilder:
    """Documents of one task until the shard is full, then its row of the index."""

    def __init__(self, most_terms: int = SHARD_TERMS, most_docs: int = SHARD_DOCS):
        self.most_terms, self.most_docs = most_terms, most_docs
        self.names: dict[bytes, int] = {}
        self.ids: list[np.ndarray] = []
        self.doc_ids: list[int | None] = []
        self.lens: list[int] = []
        self.size = 0

    def add(self, doc_id: int | None, text: bytes) -> None:
        known, n = self.names, 0
        for words in split_terms(text):
            for w in words:
                if w not in known:
                    known[w] = len(known)
            self.ids.append(np.fromiter(map(known.__getitem__, words), np.int32, len(words)))
            n += len(words)
        self.doc_ids.append(doc_id)
        self.lens.append(n)
        self.size += n

    def full(self) -> bool:
        return self.size >= self.most_terms or len(self.lens) >= self.most_docs

    def row(self) -> dict:
        lens = np.array(self.lens, np.int64)
        names = sorted(self.names)
        rank = np.empty(len(names), np.int64)
        rank[[self.names[w] for w in names]] = np.arange(len(names))
        ids = np.concatenate(self.ids) if self.ids else np.zeros(0, np.int32)
        self.ids.clear()
        key, tf = np.unique(rank[ids] * len(lens) + np.repeat(np.arange(len(lens)), lens), return_counts=True)
        term, doc = np.divmod(key, max(len(lens), 1))
        return {
            "doc_ids": self.doc_ids,
            "lens": lens.tobytes(),
            "names": b"".join(names),
            "name_ends": np.cumsum([len(w) for w in names], dtype=np.int64).tobytes(),
            **packed(term, doc, tf, lens[doc], len(names)),
        }


def widths_of(most: np.ndarray) -> np.ndarray:
    """Bytes that a value takes: 1, 2 or 4."""
    return np.where(most < 1 << 8, 1, np.where(most < 1 << 16, 2, 4))


def packed(term: np.ndarray, doc: np.ndarray, tf: np.ndarray, n: np.ndarray, terms: int) -> dict[str, bytes]:
    """Lists of (doc, tf), in the order of term and doc, as blocks of gaps and counts in as few bytes as fit.

    Beside each block stand its last document and the pairs (tf, length) that no other of the block beats with
    more occurrences in fewer terms: whatever the corpus' statistics turn out to be, its highest impact is theirs.
    """
    dfs = np.bincount(term, minlength=terms)
    if not len(term):
        none = {c: b"" for c in ("lasts", "widths", "pair_counts", "pair_tfs", "pair_lens", "postings")}
        return {"dfs": dfs.astype(np.int32).tobytes(), **none}
    place = np.arange(len(term)) - (np.cumsum(dfs) - dfs)[term]
    first = np.flatnonzero(place % BLOCK == 0)
    count = np.diff(np.append(first, len(term)))
    block = np.repeat(np.arange(len(first)), count)
    gap = np.diff(doc, prepend=-1) - 1
    gap[place == 0] = doc[place == 0]
    wide_gap, wide_tf = (widths_of(np.maximum.reduceat(x, first)) for x in (gap, tf))
    start = np.cumsum(count * (wide_gap + wide_tf)) - count * (wide_gap + wide_tf)
    inside = np.arange(len(term)) - first[block]
    out = np.zeros(int(start[-1] + count[-1] * (wide_gap[-1] + wide_tf[-1])), np.uint8)
    for values, wide, base in ((gap, wide_gap, start), (tf, wide_tf, start + count * wide_gap)):
        at = base[block] + inside * wide[block]
        for k in range(4):
            use = wide[block] > k
            out[at[use] + k] = values[use] >> 8 * k & 255
    best = np.lexsort((n, -tf, block))
    low = n[best] - block[best] * (int(n.max()) + 1)  # each block lies below those before it
    keep = np.append(True, low[1:] < np.minimum.accumulate(low)[:-1])
    best = best[keep]
    return {
        "dfs": dfs.astype(np.int32).tobytes(),
        "lasts": doc[first + count - 1].astype(np.int32).tobytes(),
        "widths": (wide_gap * 8 + wide_tf).astype(np.uint8).tobytes(),
        "pair_counts": np.bincount(block[best], minlength=len(first)).astype(np.int32).tobytes(),
        "pair_tfs": tf[best].astype(np.int64).tobytes(),
        "pair_lens": n[best].astype(np.int64).tobytes(),
        "postings": out.tobytes(),
    }


def build_index(docs: DataFrame, scratch: Scratch, shard: tuple[int, int] = (SHARD_TERMS, SHARD_DOCS)) -> DataFrame:
    """The index of every row of ``docs`` (doc_id, text): a table of shards in the checkpoint folder.

    A task makes shards of its own rows, so nothing is shuffled and no term's list grows with the corpus.  A
    row is a document; null and empty texts are documents without terms; a doc_id may be null or repeat.
    ``shard``: after how many terms or documents a shard ends.
    """
    text_batches(docs.sparkSession)
    plain = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )

    @frugal
    def run(batches):
        open_shard = ShardBuilder(*shard)
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
                open_shard.add(doc_id.as_py(), text.as_py())
                if open_shard.full():
                    yield as_batch(open_shard)
                    open_shard = ShardBuilder(*shard)
        if open_shard.lens:
            yield as_batch(open_shard)

    def as_batch(full):
        binary = pa.binary()
        types = [("doc_ids", pa.list_(pa.int64())), *((c.split()[0], binary) for c in INDEX.split(", ")[1:])]
        return pa.RecordBatch.from_pylist([full.row()], pa.schema(types))

    return scratch.keep(plain.withColumn("text", F.col("text").cast("binary")).mapInArrow(run, INDEX), "index")


class Names:
    """A shard's sorted terms, found by bisection."""

    def __init__(self, row: dict):
        self.all, self.ends = row["names"], np.frombuffer(row["name_ends"], np.int64)

    def __len__(self) -> int:
        return len(self.ends)

    def __getitem__(self, i: int) -> bytes:
        return self.all[self.ends[i - 1] if i else 0 : self.ends[i]]

    def find(self, term: bytes) -> int | None:
        i = bisect_left(self, term)
        return i if i < len(self) and self[i] == term else None


def impact(tf: np.ndarray, n: np.ndarray, docs: int, terms: int) -> np.ndarray:
    """What an occurrence is worth before its term's weight, by the contract's whole numbers."""
    m = 100 - 25 + 25 * n * docs // terms
    return 1_000_000_000 * tf // (1_000 * tf + 12 * m)


class Shard:
    """One row of the index: bounds come from the blocks' pairs, postings are unpacked when they are needed."""

    def __init__(self, row: dict, docs: int, terms: int):
        read = lambda c, kind: np.frombuffer(row[c], kind)
        self.names, self.stats = Names(row), (docs, terms)
        self.lens = read("lens", np.int64)
        top = np.iinfo(np.int64).max
        self.doc_ids = np.array([top if d is None else d for d in row["doc_ids"]], np.int64)
        self.dfs = read("dfs", np.int32).astype(np.int64)
        blocks = -(-self.dfs // BLOCK)
        self.ends = np.cumsum(blocks)
        self.lasts = read("lasts", np.int32).astype(np.int64)
        self.count = np.full(len(self.lasts), BLOCK)
        self.count[self.ends[blocks > 0] - 1] = self.dfs[blocks > 0] - (blocks[blocks > 0] - 1) * BLOCK
        wide = read("widths", np.uint8).astype(np.int64)
        self.wide_gap, self.wide_tf = wide // 8, wide % 8
        size = self.count * (self.wide_gap + self.wide_tf)
        self.start = np.cumsum(size) - size
        self.pair_ends = np.cumsum(read("pair_counts", np.int32), dtype=np.int64)
        self.pair_tfs, self.pair_lens = read("pair_tfs", np.int64), read("pair_lens", np.int64)
        self.postings = row["postings"]
        self.known: dict[bytes, tuple] = {}
        self.unpacked: dict[int, tuple] = {}

    def blocks(self, term: bytes) -> tuple[int, np.ndarray, np.ndarray] | None:
        """(first block, the blocks' last documents, their highest impacts) of a term's list."""
        if term not in self.known:
            i = self.names.find(term)
            if i is None:
                self.known[term] = None
            else:
                a, b = int(self.ends[i - 1]) if i else 0, int(self.ends[i])
                p = int(self.pair_ends[a - 1]) if a else 0
                q = int(self.pair_ends[b - 1])
                worth = impact(self.pair_tfs[p:q], self.pair_lens[p:q], *self.stats)
                starts = np.append(p, self.pair_ends[a : b - 1]) - p
                self.known[term] = a, self.lasts[a:b], np.maximum.reduceat(worth, starts)
        return self.known[term]

    def unpack(self, block: int, first: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, impacts) of a block of the list that begins at block ``first``."""
        if block not in self.unpacked:
            n, at = int(self.count[block]), int(self.start[block])
            a, b = int(self.wide_gap[block]), int(self.wide_tf[block])
            gaps = np.frombuffer(self.postings, f"<u{a}", n, at).astype(np.int64)
            tf = np.frombuffer(self.postings, f"<u{b}", n, at + n * a).astype(np.int64)
            base = int(self.lasts[block - 1]) if block > first else -1
            docs = base + np.cumsum(gaps + 1)
            self.unpacked[block] = docs, impact(tf, self.lens[docs], *self.stats)
        return self.unpacked[block]

    def search(self, weights: dict[bytes, int], best: tuple[np.ndarray, np.ndarray], top: int):
        """The ``top`` (scores, doc_ids) of ``best`` and this shard's documents, and how many blocks were unpacked.

        All lists' block ends cut the documents into ranges.  Within a range each list's pointer, moved only
        over block ends, stands in one block, so the sum of these blocks' highest impacts bounds every score in
        it: the test that pivots are put to, for all ranges at once.  Ranges are visited by falling bound, a few
        at first and then four times as many; those below the threshold, the score to beat, are never unpacked.
        """
        lists = [(w, found) for t, w in weights.items() if w > 0 and (found := self.blocks(t))]
        if not lists:
            return best, 0
        edges = np.unique(np.concatenate([ends for _, (_, ends, _) in lists]))
        bound = np.zeros(len(edges), np.int64)
        stands = []
        for w, (_, ends, worth) in lists:
            at = np.searchsorted(ends, edges)
            inside = at < len(ends)
            bound[inside] += w * worth[at[inside]]
            stands.append(np.where(inside, at, -1))
        order = np.argsort(-bound, kind="stable")
        room = np.diff(edges, prepend=-1)
        done, step, opened = 0, 8, set()
        while done < len(order):
            threshold = int(best[0][top - 1]) if len(best[0]) >= top else 1
            ranges = order[done : done + step]
            ranges = ranges[bound[ranges] >= threshold]
            if not len(ranges):
                break
            here = np.zeros(len(edges), bool)
            here[ranges] = True
            wanted = np.repeat(here, room)
            score = np.zeros(len(wanted), np.int64)
            for (w, (first, _, _)), at in zip(lists, stands):
                use = np.unique(at[ranges])
                use = use[use >= 0] + first
                opened.update(use.tolist())
                for block in use.tolist():
                    docs, worth = self.unpack(block, first)
                    fit = wanted[docs]
                    score[docs[fit]] += w * worth[fit]
            found = np.flatnonzero(score >= threshold)
            best = best_of(best, (score[found], self.doc_ids[found]), top)
            done, step = done + step, step * 4
        return best, len(opened)


def best_of(a: tuple, b: tuple, top: int) -> tuple[np.ndarray, np.ndarray]:
    """The highest scores of both, equal ones by ascending doc_id."""
    scores, ids = np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
    order = np.lexsort((ids, -scores))[:top]
    return scores[order], ids[order]


def statistics(index: DataFrame, terms: set[bytes]) -> tuple[int, int, dict[bytes, int]]:
    """Documents with a term, all terms with repeats, and in how many documents each of ``terms`` is, over all shards."""

    def run(batches):
        total = Counter()
        docs = words = 0
        for batch in batches:
            for row in batch.to_pylist():
                lens, names = np.frombuffer(row["lens"], np.int64), Names(row)
                dfs = np.frombuffer(row["dfs"], np.int32)
                docs, words = docs + int((lens > 0).sum()), words + int(lens.sum())
                for t in terms:
                    if (i := names.find(t)) is not None:
                        total[t] += int(dfs[i])
        rows = [(None, docs, words), *((t, n, 0) for t, n in total.items())]
        yield pa.record_batch([pa.array(c) for c in zip(*rows)], names=["term", "docs", "terms"])

    part = index.select("lens", "names", "name_ends", "dfs").mapInArrow(run, "term binary, docs long, terms long")
    rows = part.groupBy("term").agg(F.sum("docs").alias("docs"), F.sum("terms").alias("terms")).collect()
    of = {r["term"] if r["term"] is None else bytes(r["term"]): (r["docs"], r["terms"]) for r in rows}
    docs, words = of.pop(None, (0, 0))
    return docs, words, {t: n for t, (n, _) in of.items()}


def weight(docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


def search_index(index: DataFrame, items: dict[int, Counter], top: int = 20) -> DataFrame:
    """(item_id, doc_id, score): each task's ``top`` documents of every item (its terms and how often it has them).

    A task hands the scores to beat from shard to shard.
    """
    docs, words, dfs = statistics(index, {t for own in items.values() for t in own})
    weights = {i: {t: n * weight(docs, dfs[t]) for t, n in own.items() if t in dfs} for i, own in items.items()}

    @frugal
    def run(batches):
        none = np.zeros(0, np.int64)
        best = {i: (none, none) for i in weights}
        for batch in batches:
            for k in range(len(batch)):
                shard = Shard(batch.slice(k, 1).to_pylist()[0], docs, words)
                for i, own in weights.items():
                    best[i], _ = shard.search(own, best[i], top)
        for i, (scores, ids) in best.items():
            lost = ids == np.iinfo(np.int64).max
            cols = [pa.array(np.full(len(ids), i)), pa.array(ids, mask=lost), pa.array(scores)]
            yield pa.RecordBatch.from_arrays(cols, schema=FOUND)

    return index.mapInArrow(run, "item_id long, doc_id long, score long")


def ranked_search(
    docs: DataFrame, items: DataFrame, top: int = 20, shard: tuple[int, int] = (SHARD_TERMS, SHARD_DOCS)
) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` rows of ``docs`` (doc_id, text) for every item (item_id, text).

    Scores are whole numbers by the contract of ``op12``; equal ones rank by doc_id, a null one last.  Items
    without a term that any document has give no rows, nor do items without an id; rows of one item_id are one
    item with the terms of all its different texts.  A term that an item repeats counts as often.  No documents
    or no items give no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    index = build_index(docs, Scratch(spark), shard)
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    asked = asked.where("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    jobs = max(1, -(-asked.select("item_id").distinct().count() // ITEMS_AT_ONCE))
    found = None
    for k in range(jobs):
        block: dict[int, Counter] = {}
        for r in asked.where(F.pmod(F.xxhash64("item_id"), F.lit(jobs)) == k).toLocalIterator():
            own = block.setdefault(r["item_id"], Counter())
            for words in split_terms(r["text"].encode()):
                own.update(words)
        part = search_index(index, block, top)
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("item_id", "rank", "doc_id", "score")


def op12_ranked_search(spark, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_low = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_term = r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'"
OP12_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_low.format("text")}, {_term}) AS own FROM documents
           WHERE text IS NOT NULL),
s AS (SELECT count(*) AS docs, sum(len(own))::BIGINT AS words FROM d WHERE len(own) > 0),
q AS (SELECT item_id, term, count(*) AS times FROM
      (SELECT item_id, unnest(regexp_extract_all({_low.format("text")}, {_term})) AS term FROM benchmark)
      GROUP BY ALL),
p AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(own) AS n, unnest(own) AS term FROM d)
      GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
g AS (SELECT item_id, doc_id, sum(times * floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::BIGINT *
        ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * docs) // words))))::BIGINT AS score
      FROM q JOIN f USING (term) JOIN p USING (term), s GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM g
      WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 20
"""
