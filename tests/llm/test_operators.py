"""Small fixtures against brute force: nulls, empties, long texts, ties, repeats, clashing columns."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from airloom.llm import common, langid, merkle, mixing, packing, simhash, substring, tokens, toxicity, urls, vectors

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def make(spark, texts, **more):
    rows = [
        (i, t, more.get("lang", ["en"] * len(texts))[i], more.get("source", ["s"] * len(texts))[i], len(t or ""))
        for i, t in enumerate(texts)
    ]
    return spark.createDataFrame(rows, DOCS)


def words(rnd, n, vocabulary=400):
    return " ".join(f"w{rnd.randrange(vocabulary)}" for _ in range(n))


def components(n, links):
    low = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(low[a], low[b])
            changed |= low[a] != m or low[b] != m
            low[a] = low[b] = m
    return low


def test_connected_components_of_paths_stars_and_islands(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(300, 301)]
    d = common.connected_components(spark.createDataFrame(links, "a long, b long"), common.Scratch(spark))
    got = {r.node: r.root for r in d.collect()}
    ids = {
        n: r
        for n, r in zip(
            [x for p in links for x in p],
            spark.createDataFrame(
                [(x,) for p in links for x in p], "x long"
            ).select(F.xxhash64("x").alias("h")).toPandas().h,
        )
    }
    groups = {}
    for n, h in ids.items():
        groups.setdefault(got[h], set()).add(n)
    assert sorted(map(len, groups.values())) == [2, 41, 60]
    empty = common.connected_components(spark.createDataFrame([], "a long, b long"), common.Scratch(spark))
    assert empty.count() == 0


def plain_simhash(text):
    """A fingerprint by counting bits one by one."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    own = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [
        " ".join(own[i : i + 3]) for i in range(len(own) - 2)
    ] if len(own) >= 3 else [" ".join(own)] if own else []
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_equals_brute_force(spark):
    rnd = random.Random(3)
    base = [words(rnd, 300) for _ in range(12)]
    texts = [None, "", "  \n ", "one two", "One  TWO", "a\u00a0b c\u2003d É é", "İ\x1cx y Z"] + base + base[:3] + [
        b.replace("w1 ", "w2 ", 1) for b in base
    ] + [b + " tail" for b in base] + [words(rnd, 20_000)]
    d = make(spark, texts).withColumn("fp", F.lit("clash")).withColumn("component_id", F.lit(5))
    got = {r.doc_id: r for r in simhash.near_duplicates(d).collect()}
    fps = [plain_simhash(t) for t in texts]
    low = components(
        len(texts), [(a, b) for a in range(len(texts)) for b in range(a) if bin(fps[a] ^ fps[b]).count("1") <= 3]
    )
    assert [got[i].component_id for i in range(len(texts))] == low
    assert [got[i].fingerprint for i in range(len(texts))] == [f"{f:016x}" for f in fps] and fps[0] == fps[2] == 0
    kept = simhash.keep_one(d)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(low)) and kept.columns == d.columns
    assert simhash.near_duplicates(make(spark, [])).count() == 0


@pytest.mark.parametrize("crowd", [20, 900])
def test_ball_links_connect_dense_crowds(spark, crowd):
    rnd = np.random.default_rng(crowd)
    centre = rnd.integers(0, 2**63, dtype=np.int64)
    flips = [int(sum(1 << int(b) for b in rnd.choice(63, rnd.integers(0, 5), replace=False))) for _ in range(crowd)]
    fps = np.unique(np.array([int(centre) ^ f for f in flips] + rnd.integers(0, 2**63, 50).tolist(), np.int64))
    links = simhash.ball_links(spark.createDataFrame([(int(x),) for x in fps], "fp long"), len(fps)).collect()
    at = {int(x): i for i, x in enumerate(fps)}
    near = np.bitwise_count((fps[:, None] ^ fps[None, :]).view(np.uint64)) <= 3
    found = [(at[r.a], at[r.b]) for r in links]
    want = components(len(fps), np.argwhere(np.tril(near, -1)).tolist())
    assert components(len(fps), found) == want


def toxic_corpus(n=600):
    rnd = random.Random(1)
    texts, toxic = [], []
    for i in range(n):
        t = words(rnd, rnd.randrange(5, 200))
        if bad := i % 6 == 0:
            t += " " + " ".join(
                rnd.choice(["vile", "grubbish", "grubbier", "grubbest"]) for _ in range(rnd.choice([1, 2, 12]))
            )
        texts.append(t)
        toxic.append(int(bad))
    return texts, toxic


LABELS = "doc_id long, quality int, toxic int"


def test_toxicity_learns_words_and_stems(spark):
    texts, toxic = toxic_corpus()
    long = "w1 w2 " * 40_000
    docs = make(spark, [*texts, None, "", long, long + "vile grubbish " * 30])
    labels = spark.createDataFrame(
        [(i, i % 4 and 1, x) for i, x in enumerate(toxic) if i < 400] + [(None, 1, 1), (3, None, None)], LABELS
    )
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs.withColumn("severity", F.lit(9)), model).collect()}
    held = range(400, 600)
    caught = [got[i].toxic for i in held if toxic[i]]
    clean = [got[i].toxic for i in held if not toxic[i]]
    assert np.mean(caught) > 0.95 and np.mean(clean) < 0.02  # held-out recall and false alarms
    assert not got[602].toxic and got[603].toxic
    assert list(model.thresholds) == sorted(model.thresholds) and len(model.thresholds) == 2
    one = spark.createDataFrame([(0, "w1 vile"), (1, "w1 " + "vile grubbish " * 9)], "doc_id long, text string")
    s = {r.doc_id: r.severity for r in toxicity.score(one, model).collect()}
    assert s[1] > s[0] > got[600].severity == got[601].severity
    kept = toxicity.reject_toxic(docs, labels)
    assert {r.doc_id for r in kept.collect()} == {i for i in got if not got[i].toxic} and kept.columns == docs.columns
    assert toxicity.score(docs, toxicity.train(docs, labels.where("toxic = 0"))).where("toxic").count() == 0
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_repeated_labelled_rows_stay_within_the_bound(spark):
    texts, toxic = toxic_corpus(120)
    docs = make(spark, texts)
    labels = spark.createDataFrame([(i, 1, x) for i, x in enumerate(toxic)], LABELS)
    again = docs
    for _ in range(4):
        again = again.unionByName(docs)
    one, many = toxicity.train(docs, labels), toxicity.train(
        again.withColumn("grade", F.lit("clash")), labels.unionByName(labels)
    )
    assert one == many
    twice = toxicity.score(docs.limit(5).unionByName(docs.limit(5)), one)
    assert twice.count() == 10 and twice.distinct().count() == 5


def test_ordinal_gradient_equals_differences():
    rnd = np.random.default_rng(3)
    n, m = 60, 7
    row, col = np.repeat(np.arange(n), 3), rnd.integers(0, m, 3 * n)
    value, grade = rnd.normal(size=3 * n), rnd.integers(0, 4, n)
    x = np.r_[rnd.normal(size=m), -0.5, 0.1, -0.3]
    f, g = toxicity.loss(x, row, col, value, grade, m, 0.01)
    for i in range(len(x)):
        step = np.zeros(len(x))
        step[i] = 1e-6
        up, down = (toxicity.loss(x + d, row, col, value, grade, m, 0.01)[0] for d in (step, -step))
        assert abs((up - down) / 2e-6 - g[i]) < 1e-6
    s, t = np.bincount(row, x[col] * value, n), x[m] + np.r_[0, np.cumsum(np.exp(x[m + 1 :]))]
    cumulative = np.c_[np.ones(n), 1 / (1 + np.exp(t - s[:, None])), np.zeros(n)]
    by_hand = -np.mean(
        [np.log(cumulative[i, k] - cumulative[i, k + 1]) for i, k in enumerate(grade)]
    ) + 0.01 * (x[:m] ** 2).sum()
    assert abs(f - by_hand) < 1e-9


def test_ordinal_fit_recovers_order():
    rnd = np.random.default_rng(0)
    x = rnd.normal(size=4000)
    y = np.searchsorted([-1.0, 0.5, 2.0], 2 * x + rnd.logistic(size=4000))
    w, t = toxicity.fit(np.arange(4000), np.zeros(4000, int), x, y, 1, l2=1e-6)
    assert abs(w[0] - 2) < 0.2 and np.allclose(t, [-1.0, 0.5, 2.0], atol=0.2)


def brute_cut(texts):
    """(text, removed) in order, from plain strings: copied texts and lines of 25 words, and 51 words in a row."""
    wholes, lines, runs, out = {}, {}, {}, []
    for i, t in enumerate(texts):
        if t is None:
            out.append(None)
            continue
        low, spans = t.lower().split(), [m.span() for m in re.finditer(r"\S+", t)]
        windows = [" ".join(low[k : k + 51]) for k in range(len(low) - 50)]
        gone, own, at, mine = [], set(), 0, {}
        whole = " ".join(low)
        for line in t.split("\n"):
            unit, end = " ".join(line.lower().split()), min(at + len(line) + 1, len(t))
            if len(unit.split()) >= 25:
                if unit in lines or unit in own or unit in wholes:
                    gone.append((at, end, lines.get(unit, wholes.get(unit))))
                own.add(unit)
                mine.setdefault(unit, i)
            at += len(line) + 1
        if len(low) >= 25 and (whole in wholes or whole in lines):
            gone = [(0, len(t), min(x for x in (wholes.get(whole), lines.get(whole)) if x is not None))]
        else:
            keeper = {}  # the keeper of a word is that of the first run of its stretch
            stretch = None
            for k, run in enumerate(windows):
                if run in runs:
                    if stretch is None or k > max(keeper):
                        stretch = runs[run]
                    for w in range(k, k + 51):
                        keeper.setdefault(w, stretch)
            covered = lambda w: any(a <= spans[w][0] < e for a, e, _ in gone)  # noqa: B023, E731
            more, left = [], [w for w in sorted(keeper) if not covered(w)]
            for w in left:
                after = spans[w + 1][0] if w + 1 < len(spans) else len(t)
                end = after
                if w + 1 not in keeper and "\n" in t[spans[w][1] : after]:
                    end = spans[w][1]
                joined = more and more[-1][1] == spans[w][0] and w - 1 in keeper and not covered(w - 1)
                if joined:
                    more[-1] = (more[-1][0], end, more[-1][2])
                else:
                    more.append((spans[w][0], end, keeper[w]))
            bounds = sorted(a for a, _, _ in gone)
            more = [(a, min([e, *(b for b in bounds if a < b < e)]), k) for a, e, k in more]
            gone = sorted([*gone, *more], key=lambda g: g[:2])
        keep, at = [], 0
        for a, e, _ in gone:
            keep.append(t[at:a])
            at = e
        out.append(("".join([*keep, t[at:]]), gone))
        for unit in mine:
            lines.setdefault(unit, i)
        if len(low) >= 25:
            wholes.setdefault(whole, i)
        for run in windows:
            runs.setdefault(run, i)
    return out


def test_substring_dedup_equals_sequential(spark):
    rnd = random.Random(2)
    line = words(rnd, 60)
    passage = ". ".join(words(rnd, 9) for _ in range(7)) + "."
    texts = [
        None,
        "",
        line,
        "Alpha beta.\n" + line.upper() + "\nown words that only this one has",
        f"start of it {passage} and the end of it is here",
        words(rnd, 30) + ". " + passage + " " + words(rnd, 25),
        "yes.\nyes.",
        "yes.\nyes.",
        line + "\n" + line,
        words(rnd, 30_000),
    ]
    d = make(spark, texts).withColumn("removed", F.lit(1))
    got = {r.doc_id: r for r in substring.dedupe(d).collect()}
    for i, want in enumerate(brute_cut(texts)):
        if want is None:
            assert got[i].text is None and got[i].removed == []
        else:
            assert (got[i].text, [tuple(x) for x in got[i].removed]) == want
    assert got[8].text == "" and got[6].text == got[7].text == "yes.\nyes." and line.upper() not in got[3].text
    left = got[5].text
    assert len(left.split()) < len(texts[5].split()) - 50 and left.startswith(texts[5][:40])
    clean = substring.without_copies(d.drop("removed"))
    assert 8 not in {
        r.doc_id for r in clean.collect()
    } and clean.columns == DOCS.replace(" long", "").replace(" string", "").split(", ")
    assert substring.dedupe(d.limit(0)).count() == 0


def cheapest(sizes, members, quotas, repeats=3):
    """The most words that quotas allow and the least cost of taking them, by trying every amount."""
    sources = range(len(quotas))
    best = (0, 0)

    def fits(takes):
        """Whether the takes can be dealt to sources within their quotas (by Hall's condition)."""
        for mask in range(1, 1 << len(quotas)):
            own = [s for s in sources if mask >> s & 1]
            inside = sum(t for t, m in zip(takes, members) if set(m) <= set(own))
            if inside > sum(quotas[s] for s in own):
                return False
        return True

    cost = lambda t, n: sum(r * min(n, max(0, t - (r - 1) * n)) for r in range(1, repeats + 1))
    for takes in itertools.product(*[range(repeats * n + 1) for n in sizes]):
        if fits(takes):
            best = min(best, (-sum(takes), sum(map(cost, takes, sizes))))
    return -best[0], best[1]


def test_targets_and_flow():
    assert mixing.targets(
        {"a": 10, "b": 100, None: 100}, {"a": 3, "b": 1, None: 2}
    ) == {"a": 30.0, "b": 60.0, None: 120.0}
    assert mixing.targets({"a": 0}, {"a": 1}) == {"a": 0.0}
    assert mixing.min_cost_flow([10], [(0,)], [1000]) == [30]
    rnd = random.Random(12)
    for _ in range(25):
        sizes = [rnd.randrange(1, 7) for _ in range(3)]
        members = [tuple(sorted(rnd.sample(range(3), rnd.randrange(1, 4)))) for _ in range(3)]
        quotas = [rnd.randrange(0, 14) for _ in range(3)]
        flow = mixing.min_cost_flow(sizes, members, quotas)
        cost = sum(r * min(n, max(0, t - (r - 1) * n)) for t, n in zip(flow, sizes) for r in (1, 2, 3))
        assert (sum(flow), cost) == cheapest(sizes, members, quotas)


def test_mixing_meets_targets_with_overlapping_and_null_sources(spark):
    rnd = random.Random(4)
    texts = [words(rnd, rnd.randrange(1, 90)) for _ in range(200)] + [None, "", words(rnd, 3000)]
    source = [rnd.choice(["a", "a", "a", "b", None]) for _ in texts]
    d = make(spark, texts, source=source)
    names = ("size", "taken", "pattern", "edge", "rest", "at", "passes", "before", "n", "s", "name", "h")
    clash = d.withColumns({c: F.lit(f"own {c}") for c in names})
    out, sizes, goal = mixing.mix(clash, F.array("source"))
    got = out.collect()
    assert len(got) == len(texts) and all(0 <= r.taken <= 3 * r.size for r in got)
    assert all(
        r.size == len((texts[r.doc_id] or "").split()) and r.edge == "own edge" and r.rest == "own rest" for r in got
    )
    for s in sizes:
        assert abs(sum(r.taken for r in got if r.source == s) - goal[s]) <= 1
    assert sorted(
        (r.doc_id, r.taken) for r in mixing.mix(d, F.array("source"))[0].collect()
    ) == sorted((r.doc_id, r.taken) for r in got)
    both = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("p"), F.lit("q"))).otherwise(F.array(F.lit("q")))
    twice, sizes, goal = mixing.mix(d, both)
    rows = twice.collect()
    shared = sum(r.size for r in rows if r.doc_id % 2 == 0)
    assert sizes == {"p": shared, "q": sum(r.size for r in rows)}
    # p can only be met by documents that also are in q: both targets together by all that is taken
    assert abs(sum(r.taken for r in rows) - sum(int(g + 0.5) for g in goal.values())) <= 1
    assert mixing.mix(d.limit(0), F.array("source"))[0].count() == 0
    kept = mixing.mixed_documents(clash)
    assert kept.columns == clash.columns and {r["size"] for r in kept.select("size").collect()} == {"own size"}
    again = d.where("doc_id < 20")
    same = mixing.mix(again.unionByName(again), F.array("source"))[0].collect()
    by = {}
    for r in same:
        by.setdefault(r.doc_id, []).append(r.taken)
    assert all(len(v) == 2 and v[0] == v[1] for v in by.values())


def test_cutting_stock_covers_demand_near_the_bound():
    rnd = np.random.default_rng(5)
    for demand in (np.ones(1), rnd.integers(1, 400, 120), rnd.integers(0, 3, 512) + 1):
        width = np.sort(rnd.choice(np.arange(1, 513), len(demand), replace=False))
        used, bound = packing.cutting_stock(width, demand.astype(float), 512)
        assert (sum(c * t for c, t in used) == demand).all() and all(c @ width <= 512 for c, _ in used)
        n = sum(t for _, t in used)
        assert bound <= n + 1e-6 and n <= 1.03 * bound + 2


def check_pieces(got, texts, times=None):
    """Every id in one piece of its document, checksums, and gapless sequences; the number of sequences."""
    tok = packing._tokenizer(packing.default_tokenizer())
    by, lines = {}, {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
        lines.setdefault(r.sequence_id, []).append(r)
    for i, t in enumerate(texts):
        ids, at = tok.encode(t or "", add_special_tokens=False).ids + [1], 0
        for r in sorted(by[i], key=lambda r: r.start)[:: (times or {}).get(i, 1)]:
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for own in lines.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))]
        assert sum(r.length for r in own) <= 2048
    return len(lines)


def test_packing_round_trip(spark):
    rnd = random.Random(6)
    texts = [
        None, "", "x", words(rnd, 9000), "a\u00a0b\x0bc\x1cd 'tis é"
    ] + [words(rnd, rnd.randrange(1, 600)) for _ in range(120)] + ["same text here"] * 40
    d = make(spark, texts).withColumn("length", F.lit("clash"))
    path = packing.default_tokenizer()
    got = packing.pack(d.unionByName(d.where("doc_id = 2")), path).collect()
    assert check_pieces(got, texts, {2: 2}) <= sum(r.length for r in got) / 2048 * 1.02 + 2
    assert packing.pack(d.limit(0), path).count() == 0


@pytest.mark.parametrize("tokens", [1500, 1100, 700, 1025])
def test_lengths_that_do_not_combine_are_cut(spark, tokens):
    texts = ["the " * (tokens - 1)] * 150 + ["a b c"] * 3
    got = packing.pack(make(spark, texts), packing.default_tokenizer()).collect()
    n = check_pieces(got, texts)
    assert n * 2048 <= 1.06 * sum(r.length for r in got) + 4096


def test_checksums_of_parts_join():
    rnd = random.Random(8)
    for _ in range(50):
        parts = [rnd.randbytes(rnd.choice([0, 1, 4, 255, 256, 1000])) for _ in range(rnd.randrange(0, 6))]
        assert packing.joined_crc([(zlib.crc32(p), len(p)) for p in parts]) == zlib.crc32(b"".join(parts))


def test_chunked_ids_equal_whole_texts():
    rnd = random.Random(2)
    parts = [
        "a", "b", "the", "E", "é", "É", "ß", "ÿ", "×", "÷", "ª", "º", "µ", "İ", "Σ", "ς", "ﬁ", "\u0301", "1", "2", "½", "²", "٣", "漢", "字", "か", "😀", "'", "’",
        "'s", "'LL", "'re", "!", "?", ".", ",", "..", ",.", "-", "_", "(", '"', "\x0b", "\x0c", "\x1c", "\x1f", "\x85", "\xa0", "\u2003", "\u200b", " ", "\n", "\t", "\r",
        "  ", "\u212a", "ſ", "Ǆ", "가", "\u0900", "\u0327", "\x00", "\x7f", "\u2028",
    ]
    path = packing.default_tokenizer()
    tok, encode = packing._tokenizer(path), packing.ChunkEncoder(path)
    for _ in range(20_000):
        t = "".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 14)))
        assert encode([t])[0] == np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), repr(t)


def test_the_cache_of_chunks_is_bounded(monkeypatch):
    monkeypatch.setattr(packing, "CACHED_CHUNKS", 50)
    path, rnd = packing.default_tokenizer(), random.Random(3)
    tok, encode = packing._tokenizer(path), packing.ChunkEncoder(path)
    for _ in range(30):
        t = words(rnd, 40, 10**6)
        assert encode([t])[0] == np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
        assert len(encode.known) <= 50 + 40


def test_language_filters(spark):
    rnd = random.Random(7)
    make_text = lambda p, n: " ".join("".join(rnd.choice(p) for _ in range(rnd.randrange(2, 4))) for _ in range(n))
    parts = {"aa": ["ka", "lo", "mi"], "bb": ["kä", "ro", "sü"], "cc": ["qu", "lo", "ez"]}
    lang = [rnd.choice(list(parts)) for _ in range(300)]
    texts = [
        make_text(parts[x], rnd.randrange(3, 200)) for x in lang
    ] + [None, "", "123 !?", make_text(parts["bb"], 60_000)]
    lang += ["aa", None, "bb", "bb"]
    d = make(spark, texts, lang=lang)
    got = {r.doc_id: r for r in langid.identify(d.withColumn("score", F.lit("x")), langid.learn(d)).collect()}
    assert [got[i].lang_pred for i in (300, 301, 302, 303)] == ["und", "und", "und", "bb"]
    held = [i for i in range(300) if got[i].held_out]
    assert all(
        got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got
    ) and np.mean([got[i].lang_pred == lang[i] for i in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in got.values())
    none = langid.identify(d, langid.learn(d.withColumn("lang", F.lit(None).cast("string")))).collect()
    assert {r.lang_pred for r in none} == {"und"} and langid.identify(d.limit(0), langid.learn(d)).count() == 0


def test_filters_equal_exact_sets_within_their_error(spark):
    rnd = random.Random(17)
    parts = {"aa": ["kal", "lom", "min", "tor"], "bb": ["käl", "rov", "sün"], "cc": ["quv", "lom", "eza"]}
    make_text = lambda p, n: " ".join("".join(rnd.choice(p) for _ in range(rnd.randrange(1, 4))) for _ in range(n))
    lang = [rnd.choice(list(parts)) for _ in range(200)]
    texts = [make_text(parts[x], rnd.randrange(2, 120)) for x in lang]
    texts += [make_text(parts["aa"] + parts["cc"], 60), "lom lom", "zzz yyy"] + texts[:5]
    lang += [None] * 3 + lang[:5]
    d = make(spark, texts, lang=lang)
    filters = langid.learn(d)

    def grams(t):
        c = ["\0", *[x if x.isalpha() else "\0" for x in t.lower()], "\0"]
        return ["".join(c[i : i + 3]) for i in range(len(c) - 2) if c[i + 1] != "\0"]

    counts = {}
    for i, (t, x) in enumerate(zip(texts, lang)):
        if x and zlib.crc32(str(i).encode()) % 5:
            for g in grams(t):
                own = counts.setdefault(x, {})
                own[g] = own.get(g, 0) + 1
    exact = {x: {g for g, n in own.items() if n >= langid.LEAST_SHARE * sum(own.values())} for x, own in counts.items()}
    assert filters.languages == tuple(sorted(exact))
    key = lambda g: sum((0 if c == "\0" else ord(c)) << (21 * (2 - k)) for k, c in enumerate(g))
    every = sorted(set().union(*exact.values()))
    masks = filters.contained(np.array([key(g) for g in every], np.uint64))
    rates = filters.rates()
    for i, x in enumerate(filters.languages):
        found = {g for g, m in zip(every, filters.holding(masks, i).tolist()) if m}
        assert exact[x] <= found and len(found - exact[x]) <= 3 + 10 * rates[i] * len(every)
    got = {r.doc_id: r for r in langid.identify(d, filters).collect()}
    for i, t in enumerate(texts):
        own = grams(t)
        share = [sum(g in exact[x] for g in own) / len(own) for x in filters.languages]
        best = int(np.argmax(share))
        assert got[i].lang_pred == filters.languages[best] and abs(got[i].score - share[best]) < 0.01
    assert all(got[203 + k][2:] == got[k][2:] for k in range(5))


def test_more_languages_than_bits_of_a_word(spark):
    rnd = random.Random(31)
    names = [f"l{i:02}" for i in range(70)]
    own = {x: ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(4)] for x in names}
    lang = [x for x in names for _ in range(6)]
    texts = [" ".join(rnd.choice(own[x]) for _ in range(30)) for x in lang]
    d = make(spark, texts, lang=lang)
    filters = langid.learn(d)
    assert filters.table.shape[1] == 2 and len(filters.languages) == 70
    got = {r.doc_id: r.lang_pred for r in langid.identify(d, filters).collect()}
    assert [got[i] for i in range(len(lang))] == lang


def test_token_attribution_equals_bytes(spark):
    import public_tokenizers as P

    texts = [None, "", "one\n\n  two \n three", "é漢😀\né", "a" * 30_000, "x\n" * 500]
    halves = lambda t: [0] + ([len(t) // 2] if len(t) > 1 else [])
    path = P.path("byte_bpe_50k.tiktoken")
    for cut in (tokens.line_starts, halves):
        got = tokens.token_counts(make(spark, texts).withColumn("tokens", F.lit(1)), path, P.PATTERN, cut).collect()
        enc, _ = tokens._encoding(path, P.PATTERN)
        for i, t in enumerate(texts):
            own, t = sorted((r for r in got if r.doc_id == i), key=lambda r: r.section), t or ""
            ids = enc.encode_ordinary(t)
            assert "".join(
                t[r.start : r.end] for r in own
            ) == t and sum(r.tokens for r in own) == len(ids) == own[0].doc_tokens
            ends, count, at = [len(t[: r.end].encode()) for r in own], [0] * len(own), 0
            for x in ids:
                n = len(enc.decode_single_token_bytes(x))
                share = [max(0, min(at + n, e) - max(at, s)) for s, e in zip([0, *ends], ends)]
                count[share.index(max(share))] += 1
                at += n
            assert [r.tokens for r in own] == count


def test_token_counts_of_repeated_and_very_long_rows(spark):
    import public_tokenizers as P

    texts = ["one\ntwo words", "line of words\n" * 30_000]
    d = make(spark, texts).withColumn("section", F.lit("clash"))
    path = P.path("byte_bpe_50k.tiktoken")
    one = tokens.token_counts(d, path, P.PATTERN)
    many = tokens.token_counts(d.unionByName(d), path, P.PATTERN)
    assert many.count() == 2 * one.count() and many.distinct().count() == one.count() == 2 + 30_000
    assert tokens.token_counts(d.limit(0), path, P.PATTERN).count() == 0


def test_fingerprints_are_spread_before_their_keys(spark):
    fps = spark.range(10).select(F.col("id").alias("fp")).coalesce(1)
    n = -(-100_000 * 196 // simhash.ROWS_PER_TASK)
    plan = simhash.ball_links(fps, 100_000)._jdf.queryExecution().toString()
    assert f"RoundRobinPartitioning({-(-n // simhash.SPREAD)})" in plan and "hashpartitioning(key" in plan


def test_url_rules(spark):
    cases = {
        None: ("", "", None, "allow"), "no scheme": ("", "", None, "allow"), "http://A.Org/x?y": ("a.org", "/x", "org/", "allow"), "http://org": ("org", "", None, "allow"), "https://w.EXAMPLE.org/es/1#t": ("w.example.org", "/es/1", "example.org/es/", "block"),
        "x://example.org/en/19": (
            "example.org", "/en/19", "example.org/en/1", "block"
        ), "x://example.org/en/29": ("example.org", "/en/29", "org/", "allow"), "x://notexample.org/es/": ("notexample.org", "/es/", "org/", "allow"), "x://a.com/fr/": ("a.com", "/fr/", "com/fr/", "allow"),
        "x://a.com/FR/": ("a.com", "/FR/", None, "allow"), "x://b.com/de/://q": ("b.com", "/de/://q", "com/de/", "block"), "x://casino.example.net/": ("casino.example.net", "/", None, "block"), "x://a.net/login": ("a.net", "/login", None, "block"), "x://a.net/logins": ("a.net", "/logins", None, "allow"),
    }
    d = spark.createDataFrame(
        [(i, u) for i, u in enumerate(cases)], "page_id long, url string"
    ).withColumn("host", F.lit("clash"))
    got = sorted(urls.judge(d).collect())
    assert [(r.host, r.path, r.rule, r.verdict) for r in got] == list(cases.values())
    every = urls.HOST_RULES + urls.METHOD_RULES
    for r in got:
        fit = [x for x in every if re.search(x.pattern, r.host + r.path)]
        best = max((x for x in fit if x.name), key=lambda x: len(x.name), default=None)
        assert r.rule == (best.name if best else None)
    assert urls.judge(d.limit(0)).count() == 0


def test_many_parsed_rules_equal_trying_all(spark):
    rnd = random.Random(21)
    names = [f"{a}{b}" for a in ("shop", "news", "bet", "film", "bank") for b in range(40)]
    lines = [
        "! a comment",
        "",
        "||shop1.example^",
        "@@||good.shop1.example^",
        "/track[0-9]+/",
        "|https://exact.net/a",
        "*banner*ad*.gif",
        "-popup-",
        "||news2.org/live/",
        ".swf|",
    ]
    lines += [
        f"||{n}.{rnd.choice(['com', 'net'])}^" for n in names[:120]
    ] + [f"/{n}/*/x{i}^" for i, n in enumerate(names[120:])]
    rules = urls.parse_rules(lines)
    assert len(rules) == len(lines) - 2
    cases = [
        None,
        "https://good.shop1.example/",
        "https://a.shop1.example/x",
        "https://exact.net/abc",
        "http://exact.net/a",
        "x://q.org/banner/my.ad/z.GIF",
        "x://n.org/a-popup-b",
        "x://a.news2.org/live/1",
        "x://news2.org/liver",
        "x://e.org/f.swf",
        "x://e.org/f.swf?x",
        "x://e.org/track12/",
        "x://e.org/track/",
    ]
    for i, n in enumerate(names):
        cases += [
            f"https://w.{n}.com/p",
            f"https://{n}.net",
            f"http://h.org/{n}/mid/x{i - 120}",
            f"http://h.org/{n}/mid/x{i - 120}y",
        ]
    cases += cases[:9] + ["https://w.org/" + "a/" * 50_000 + "track7/"]
    d = spark.createDataFrame(
        [(i, u) for i, u in enumerate(cases)], "page_id long, url string"
    ).withColumn("verdict", F.lit("clash"))
    got = sorted(urls.judge(d, rules).collect())
    for r, url in zip(got, cases):
        whole = r.host + r.path
        fit = [x for x in rules if re.search(x.pattern, whole if not x.whole else (url or ""), re.S | re.I)]
        want = "allow" if any(x.verdict == "allow" for x in fit) else "block" if fit else "allow"
        assert (r.page_id, r.verdict) == (r.page_id, want), (url, fit)
    blocked = {cases[r.page_id] for r in got if r.verdict == "block"}
    assert "https://a.shop1.example/x" in blocked and "https://good.shop1.example/" not in blocked
    assert "https://exact.net/abc" in blocked and "http://exact.net/a" not in blocked and "x://e.org/f.swf?x" not in blocked
    assert {"x://q.org/banner/my.ad/z.GIF", "x://n.org/a-popup-b", "x://e.org/f.swf", "x://e.org/track12/"} <= blocked
    assert max(r.candidates for r in got) < len(rules) / 4


def test_vectors_equal_brute_force(spark):
    rnd = np.random.default_rng(8)
    v, label = [], []
    for c in range(12):
        centre = rnd.normal(size=16)
        for _ in range(25):
            v.append((centre + 0.12 * rnd.normal(size=16)).tolist())
            label.append(int(c % 3))
    v += [v[0]] * 30 + [None, [], [0.0] * 16, [float("nan")] * 16, [None] * 16, [1.0, 2.0], [2.0, 4.0]]
    label += [label[0]] * 30 + [0] * 5 + [1, 1]
    label[5] = None
    d = spark.createDataFrame(
        [(i, x, y) for i, (x, y) in enumerate(zip(v, label))], "vec_id long, embedding array<double>, label int"
    ).withColumn("node", F.lit("clash"))
    got = {r.vec_id: r for r in vectors.near_duplicates(d).collect()}
    ok = lambda x: bool(x) and None not in x and all(np.isfinite(x)) and any(x)
    links = []
    for a in range(len(v)):
        for b in range(a):
            if label[a] is not None and label[a] == label[b] and ok(v[a]) and ok(v[b]) and len(v[a]) == len(v[b]):
                if np.dot(v[a], v[b]) / np.linalg.norm(v[a]) / np.linalg.norm(v[b]) >= 0.98:
                    links.append((a, b))
    degree = np.bincount(np.array(links).ravel(), minlength=len(v))
    assert [got[i].n_links for i in range(len(v))] == degree.tolist()
    low = components(len(v), links)
    assert [
        got[i].component_id for i in range(len(v))
    ] == low and [got[i].kept for i in range(len(v))] == [low[i] == i for i in range(len(v))]
    assert vectors.near_duplicates(d.limit(0)).count() == 0


def test_graph_search_recall_over_many_shards(spark, monkeypatch):
    monkeypatch.setattr(vectors, "SHARD_ROWS", 60)
    monkeypatch.setattr(vectors, "DENSE", 5)
    rnd = np.random.default_rng(9)
    x = np.concatenate([c + 0.1 * rnd.normal(size=(40, 12)) for c in rnd.normal(size=(15, 12))])
    d = spark.createDataFrame(
        [(i, r.tolist(), 1) for i, r in enumerate(x)], "vec_id long, embedding array<double>, label int"
    )
    u = x / np.linalg.norm(x, axis=1)[:, None]
    exact = ((u @ u.T) >= 0.98).sum() - len(x)
    found = sum(r.n_links for r in vectors.near_duplicates(d).collect())
    assert 0.95 * exact <= found <= exact


def plain_leaves(line):
    """The leaves of a line, cut by hand."""
    out, last = [], 0
    for i in range(1, len(line) + 1):
        word_end = i > 1 and line[i - 2] in "oty0123456789.!?;:," and line[i - 1] in " \t"
        if word_end or i - last == 64:
            out.append(line[last:i])
            last = i
    return [f"{xxhash.xxh64_intdigest(x.encode(), 42) & 0xFFFFFFFF:08x}" for x in [*out, line[last:]] if x]


def plain_tree(text):
    """(root, sections), a section being its digest and (digest, leaves) of its lines."""
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    sections = []
    for section in text.split("\n\n"):
        lines = [(sha(x), plain_leaves(x)) for x in section.split("\n")]
        sections.append((sha("".join(d for d, _ in lines)), lines))
    return sha("".join(d for d, _ in sections)), sections


def plain_fingerprint(text):
    root, sections = plain_tree(text)
    show = lambda lines: ",".join(f"{d[:8]}:{len(own)}" for d, own in lines)
    own = "".join(leaf for _, lines in sections for _, leaves in lines for leaf in leaves)
    return f"{root}|" + "/".join(f"{d[:8]}({show(lines)})" for d, lines in sections) + f"|{own}"


def plain_likeness(a, b):
    x, y = ({leaf for _, lines in plain_tree(t)[1] for _, own in lines for leaf in own} for t in (a, b))
    return 2 * len(x & y) / (len(x) + len(y)) if x or y else 1.0


EDIT_TEXTS = [
    "", None, "a", "ab", "One. Two, three.\n\nSection two\nline.", "same", "same", "é😀漢" * 40, " ".join(
        f"s{i}." for i in range(3000)
    ),
    "tail text. more of it.", "first. second\n\n\nthird\n", "\n", "\r\nx\r\n", "漢字。かな、" * 30, "x" * 500, "it stays, " * 5, "it stays, " * 4 + "and ends",
    "many plain words that carry no mark at all but only blanks " * 4, "many plain words that carry no mark at all but only blanks " * 5, "short",
]


def test_merkle_edits(spark):
    rows = [(i * 3 - 5, t) for i, t in enumerate(EDIT_TEXTS)]
    random.Random(1).shuffle(rows)
    clash = {
        c: F.lit("clash") for c in ("key", "head", "fingerprint", "leaves", "edited", "next", "range", "__sections")
    }
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumns(clash)
    got = sorted(merkle.fingerprint_edits(d).collect())
    plain = [t or "" for t in EDIT_TEXTS]
    for i, (r, t) in enumerate(zip(got, plain)):
        after = plain[(i + 1) % len(plain)]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        assert (r.doc_id, r.n_chars, r.edited_sha256) == (
            i * 3 - 5, len(t), hashlib.sha256(edited.encode()).hexdigest()
        )
        assert (r.fingerprint, r.edited_fingerprint) == (plain_fingerprint(t), plain_fingerprint(edited))
        assert abs(r.near_edited - plain_likeness(t, edited)) < 1e-12
        assert abs(r.near_next - plain_likeness(t, after)) < 1e-12
    assert got[5].fingerprint == got[6].fingerprint and got[5].near_next == 1.0 and got[0].near_edited == 1.0
    assert got[8].near_edited > 0.4 > got[8].near_next
    assert len({r.fingerprint[:64] for r in got}) == len(set(plain))
    one = merkle.fingerprint_edits(
        spark.createDataFrame([(None, "abcd"), (None, "abcd")], "doc_id long, text string")
    ).collect()
    assert [(r.doc_id, r.n_chars) for r in one] == [(None, 4), (None, 4)]
    many = merkle.fingerprint_edits(
        spark.createDataFrame([(1, "abcd ef")] * 500 + [(2, "x")], "doc_id long, text string")
    ).collect()
    assert len(many) == 501 and len({r.fingerprint for r in many}) == 2
    assert merkle.fingerprint_edits(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_merkle_differences_lead_to_the_edit(spark):
    before = "Title line\nalpha beta.\n\nSecond part\nstays here\n\nlast one"
    after = "Title line\nalpha gamma.\n\nSecond part\nstays here\nnew line\n\nlast one"
    d = merkle.with_fingerprint(spark.createDataFrame([(before, after)], "a string, b string"), "a", "x")
    d = merkle.with_fingerprint(d, "b", "y")
    r = d.select(
        merkle.differences(F.col("x"), F.col("y")).alias("gone"),
        merkle.differences(F.col("y"), F.col("x")).alias("new"),
        merkle.differences(F.col("x"), F.col("x")).alias("none"),
        merkle.likeness(F.col("x"), F.col("y")).alias("near"),
    ).first()
    assert [tuple(x) for x in r.gone] == [(0, 1)] and [tuple(x) for x in r.new] == [(0, 1), (1, 2)] and r.none == []
    assert abs(r.near - plain_likeness(before, after)) < 1e-12


def test_no_python_in_the_native_plan(spark):
    d = spark.createDataFrame([(1, "a. b"), (2, "c")], "doc_id long, text string")
    plan = merkle.fingerprint_edits(d)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_pipeline_stages(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rnd = random.Random(10)
    line = words(rnd, 60)
    texts = [words(rnd, 200) for _ in range(30)]
    texts += [texts[0], texts[1], line + "\n" + words(rnd, 50), line + "\n" + words(rnd, 50), None]
    bad, toxic = toxic_corpus(240)
    texts += bad
    d = make(spark, texts, source=["x" if i % 2 else "y" for i in range(len(texts))])
    d.write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i + 35, 1, x) for i, x in enumerate(toxic) if i < 200]
    spark.createDataFrame(labels, LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    docs = d
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        path = str(tmp_path / name)
        out.write.parquet(path)
        nxt = spark.read.parquet(path)
        if name != "packing":
            assert nxt.columns == d.columns
        before, after = (
            {r.doc_id: r.text for r in x.select("doc_id", F.col(x.columns[1]).alias("text")).collect()}
            for x in (docs, nxt)
        )
        if name == "toxicity":
            gone = set(before) - set(after)
            held = [i + 35 for i in range(200, 240)]
            assert all((i in gone) == bool(toxic[i - 35]) for i in held) and not gone & set(range(35))
        if name == "simhash_near_dedup":
            assert 30 not in after and 31 not in after and set(range(30)) <= set(after)
        if name == "substring_dedup":
            assert line in after[32] and line not in after[33] and after[33] in texts[33]
        if name == "source_mixing":
            times = [r["count"] for r in nxt.groupBy("doc_id").count().collect()]
            assert set(after) <= set(before) and max(times) <= 3
        if name == "packing":
            assert set(after) == set(before)
        docs = nxt
    assert docs.count() > 0 and {"sequence_id", "offset"} <= set(docs.columns)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()
