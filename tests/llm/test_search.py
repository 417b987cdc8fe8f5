"""Ranked search against scoring every document; blocks, shards and thresholds of all sizes."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from airloom.llm import search
from airloom.llm.common import Scratch

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return TERM.findall(low)


def plain_search(docs, items, top=20):
    own = [(i, Counter(terms(t))) for i, t in docs]
    sizes = [sum(c.values()) for _, c in own]
    n_docs, n_terms = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, c in own for t in c)
    out = []
    for item, text in items:
        scores = []
        for (doc, c), n in zip(own, sizes):
            s = 0
            for t in terms(text):
                if t in c:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    s += w * ((10**9 * c[t]) // (1000 * c[t] + 12 * (75 + 25 * n * n_docs // n_terms)))
            if s > 0:
                scores.append((-s, math.inf if doc is None else doc))
        out += [
            (item, k + 1, None if d == math.inf else d, -s) for k, (s, d) in enumerate(sorted(scores)[:top])
        ]
    return sorted(out)


def corpus(rnd, n):
    common = [f"c{i}" for i in range(6)]
    rare = [f"r{i}" for i in range(300)] + ["ça", "É", "naïve", "日本", "x1"]
    out = []
    for _ in range(n):
        words = rnd.choices(common, k=rnd.randrange(0, 60)) + rnd.choices(rare, k=rnd.randrange(0, 12))
        out.append(rnd.choice([" ", ", ", "-", "\n"]).join(words))
    return out


@pytest.mark.parametrize("shard", [(3_000_000, 65_536), (300, 40), (10**9, 7)])
def test_search_equals_scoring_every_document(spark, shard):
    rnd = random.Random(shard[1])
    texts = corpus(rnd, 900) + [None, "", "..!", "C1 c1 C1", "Ça ÇA ça", "r1 " * 30_000]
    docs = list(enumerate(texts)) + [(3, texts[3]), (3, texts[3]), (None, "r2 r2 r3")]
    items = [(i, " ".join(rnd.choices(texts[i].split() or ["c1"], k=8))) for i in range(12)]
    items += [(50, None), (51, ""), (52, "nowhere"), (53, "c0 c1 c2 c3 c4 c5 r1 r2 r3"), (54, "C0 c0 C0"), (55, "日本 É ça")]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "7 AS score", "'x' AS item_id")
    q = spark.createDataFrame([*items, items[0], (None, "c1")], "item_id long, text string").selectExpr("*", "1 AS rank")
    got = sorted(tuple(r) for r in search.ranked_search(d.repartition(3), q, shard=shard).collect())
    want = plain_search(docs, items)
    # rows of one doc_id and equal scores rank in any order among themselves; they are equal rows
    assert got == want


def test_nothing_to_search(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert search.ranked_search(docs, items).count() == 0
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert search.ranked_search(some, items.where("false")).count() == 0
    assert search.ranked_search(spark.createDataFrame([(1, None)], "doc_id long, text string"), items).count() == 0


def test_items_in_several_jobs(spark, monkeypatch):
    monkeypatch.setattr(search, "ITEMS_AT_ONCE", 2)
    docs = [(i, f"a b{i % 3} c{i % 5}") for i in range(30)]
    items = [(i, f"b{i % 3} c{i}") for i in range(5)]
    got = search.ranked_search(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    )
    assert sorted(tuple(r) for r in got.collect()) == plain_search(docs, items)


def test_blocks_round_trip_and_most_stay_packed(spark):
    """A list's blocks give back its postings; a few documents that fit far better leave most blocks packed."""
    rnd = random.Random(2)
    shard = search.ShardBuilder()
    for i in range(20_000):
        words = ["gold", "silver"] * 20 if 500 <= i < 525 else [f"w{rnd.randrange(9)}" for _ in range(12)]
        shard.add(i, " ".join(words + (["gold"] if i % 3 == 0 else [])).encode())
    row = shard.row()
    s = search.Shard(row, 20_000, sum(shard.lens))
    first, ends, _ = s.blocks(b"gold")
    back = np.concatenate([s.unpack(b, first)[0] for b in range(first, first + len(ends))])
    want = [i for i in range(20_000) if i % 3 == 0 or 500 <= i < 525]
    assert back.tolist() == want
    none = np.zeros(0, np.int64)
    best, opened = s.search({b"gold": 3, b"silver": 7}, (none, none), 20)
    assert best[1].tolist() == sorted(best[1].tolist(), key=lambda d: (-best[0][list(best[1]).index(d)], d))
    assert set(best[1].tolist()) <= set(range(500, 525)) and opened < len(ends) / 4


def test_long_texts_are_split_in_pieces(monkeypatch):
    monkeypatch.setattr(search, "PIECE", 10)
    text = "Alpha beta-GAMMA delta, ünïcode x " * 7
    got = [t.decode() for part in search.split_terms(text.encode()) for t in part]
    assert got == terms(text) and sum(1 for _ in search.split_terms(text.encode())) > 10


def test_scratch_index_serves_again(spark):
    docs = spark.createDataFrame([(i, f"a b{i}") for i in range(9)], "doc_id long, text string")
    index = search.build_index(docs, Scratch(spark))
    for term in (b"b3", b"b7"):
        rows = search.search_index(index, {1: Counter([term])}).collect()
        assert [r.doc_id for r in rows] == [int(term[1:])]
