"""The prefix trie against plain dictionaries; blocks, ranges, ties, nulls and copies."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from airloom.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string"


def plain_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[c].append(((turn is not None, turn or 0, digest), (role, text)))
    own = {c: [t for _, t in sorted(v)] for c, v in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        path = own.get(c - c % 5, [])[:h] + own[c][h:]
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
        ends[tuple(path)].append(c)
    children = defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    saved, leaves = defaultdict(int), defaultdict(int)
    for node, m in members.items():
        for d in range(len(node) + 1):
            saved[node[:d]] += (len(m) - 1) * len(node[-1][1].encode()) if node else 0
            leaves[node[:d]] += not children[node]
    return sorted(
        (
            min(m), len(x), min(members[x[:-1]]) if x else -1, len(m), children[x], leaves[x], saved[x],
            hashlib.sha256(",".join(map(str, sorted(ends[x]))).encode()).hexdigest(),
        )
        for x, m in members.items()
    )


def nodes(spark, rows, block):
    d = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS n", "'x' AS key", "2 AS depth")
    got = trie.prefix_trie(trie.rebuilt(trie.numbered(d.repartition(3))), block)
    names = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()
    assert got.columns == names
    return sorted(tuple(-1 if v is None else v for v in r) for r in got.collect())


def conversations(rnd, ids, turns, vocabulary):
    out = []
    for c in ids:
        n = rnd.choice(turns)
        out += [(c, k, rnd.choice(["user", "assistant"]), rnd.choice(vocabulary)) for k in range(n)]
    return out


@pytest.mark.parametrize("block", [1, 3, 64])
def test_trie_equals_dictionaries(spark, block):
    rnd = random.Random(block)
    rows = conversations(rnd, range(60), [0, 1, 2, 5, 9, 12], ["a", "é", ""])
    rows += [(c, k, "user", f"long {k}") for c in (70, 71, 72, 78, 90) for k in range(40 if c != 78 else 33)]
    rows += [(c, k, "user", "same") for c in range(100, 160) for k in range(4)]
    rows += [(200, None, None, None), (200, None, "user", "b"), (200, 3, "user", "t"), (200, 3, "user", "t")]
    rows += [(200, 3, None, "t"), (None, 0, "user", "nobody's"), (203, 5, "user", "x" * 50_000)]
    assert nodes(spark, rows, block) == plain_trie(rows)


def test_turnless_conversations_end_at_the_root(spark):
    """Rebuilt conversations whose own turns all give way to an absent donor's have no turns."""
    lost = [c for c in range(400) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 3][:20]
    rows = [(c, k, "user", "x") for c in lost for k in range(3)]
    got = nodes(spark, rows, 64)
    assert got == plain_trie(rows) and len(got) == 1 and got[0][3] == 20 and got[0][5] == 1


def test_no_conversations(spark):
    assert nodes(spark, [], 64) == []


@pytest.mark.parametrize("cuts", [1, 2, 5, 17])
def test_runs_add_up_wherever_the_order_is_cut(cuts):
    """Points of neighbouring runs, added up by name, are those of one run, split or not."""
    rnd = random.Random(cuts)
    keys = sorted({tuple((rnd.randrange(3), 0) for _ in range(rnd.randrange(7))) for _ in range(60)})

    def total(runs):
        out = defaultdict(lambda: [0] * 5)
        for r, run in enumerate(runs):
            beside = [((0, 0, 0), list(runs[j][k])) if 0 <= j < len(runs) else None for j, k in ((r - 1, -1), (r + 1, 0))]
            p, rows = trie.Patricia(*beside), []
            for key in run:
                path = [(hash((i, t)) & 0xFFFF_FFFF, i) for i, t in enumerate(key)]
                sums = {"n": 1, "low": 0, "later": 0, "rest_bytes": 0, "rest_leaves": 0}
                p.before = p.before and (p.before[0], [(hash((i, t)) & 0xFFFF_FFFF, i) for i, t in enumerate(beside[0][1])])
                p.after = p.after and (p.after[0], [(hash((i, t)) & 0xFFFF_FFFF, i) for i, t in enumerate(beside[1][1])])
                rows += p.push((0, 0, 0), path, [t[0] + 1 for t in key], sums, 0)
            rows += p.close()
            for depth, p1, p2, *_, tails, n, _low, mb, nb, leaves, children, _top in rows:
                k = len(tails)
                out[(depth, p1, p2)] = [a + b for a, b in zip(out[(depth, p1, p2)], (n, mb, nb, leaves, children))]
                assert k >= 1
        return dict(out)

    whole = total([keys])
    edges = sorted(rnd.sample(range(1, len(keys)), cuts))
    parts = total([keys[a:b] for a, b in zip([0, *edges], [*edges, len(keys)])])
    # the first and last path of every run are split, so all runs together have at least the points of one
    assert {k: v for k, v in parts.items() if k in whole} == whole
