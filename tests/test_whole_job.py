"""Queries over tables of which an earlier cut left rows out, against brute force."""

import numpy as np


def put(spark, path, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def test_chunk_pages_reach_the_end_of_long_manuals(spark, tmp_path):
    from airloom.plans import text

    rows = [
        (i, ("ab " * (700 + 40 * (i % 7))).strip() if i % 11 else " ", "long" if i < 90 else "short") for i in range(95)
    ] + [(95, " ", "blank"), (96, None, "null")]
    sf = put(spark, tmp_path, "documents", rows, "doc_id long, text string, source string")
    want, at = {}, {}
    spans = {}
    for i, t, s in rows:
        if t is not None:
            n = len(" ".join(t.split()))
            spans.setdefault(s, []).append((i, at.get(s, 0), at.get(s, 0) + n))
            at[s] = at.get(s, 0) + n + 1
    for s, pages in spans.items():
        for k in range(-(-max(b for _, _, b in pages) // 2500)):
            hit = [i for i, a, b in pages if b > k * 2500 and a < k * 2500 + 3000]
            want[s, k] = min(hit), max(hit)
    got = {(r.doc_id, r.piece): (r.first_page, r.last_page) for r in text.q52_chunk_pages(spark, sf).collect()}
    assert got == want and max(k for s, k in got if s == "long") > 40


def test_every_twentieth_vector_asks_all(spark, tmp_path, monkeypatch):
    from airloom.operators import retrieval
    from airloom.plans import text

    monkeypatch.setattr(retrieval, "ROW_BLOCK", 70)
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 9)
    rnd = np.random.default_rng(3)
    x = rnd.normal(size=(900, 8)).astype(np.float32)
    x[500:600] = x[20]
    sf = put(
        spark,
        tmp_path,
        "embeddings",
        [(i, v.tolist(), i % 10) for i, v in enumerate(x)],
        "vec_id long, embedding array<float>, label int",
    )
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    far = np.round(1 - u @ u.T, 9)

    def best(q, ids, k):
        return sorted(ids, key=lambda i: (far[q, i], i))[:k]

    asked = range(0, 900, 20)
    got = {(r.query_id, r["rank"]): r.vec_id for r in text.q44_knn(spark, sf).collect()}
    assert got == {(q, n + 1): i for q in asked for n, i in enumerate(best(q, range(900), 5)) if n}
    got = {(r.query_id, r["rank"]): r.vec_id for r in text.q45_knn_where(spark, sf).collect()}
    assert got == {(q, n + 1): i for q in asked for n, i in enumerate(best(q, range(3, 900, 10), 4))}
    got = {r.query_id: r for r in text.q46_retrieval_stats(spark, sf).collect()}
    assert sorted(got) == list(asked)
    for q in asked:
        near = best(q, range(900), 8)
        assert got[q].manuals == sum(i % 10 < 5 for i in near) and abs(got[q].avg_distance - far[q, near].mean()) < 2e-6


def test_every_event_line_is_parsed(spark, tmp_path):
    from airloom.plans import text

    sf = put(
        spark,
        tmp_path,
        "events",
        [(i, i % 7, f"k{i % 3}") for i in range(101)],
        "event_id long, user_id long, event_type string",
    )
    got = {r.event_id: (r.unit, r.kind) for r in text.q55_kv_line_parse(spark, sf).collect()}
    assert got == {i: (f"u{i % 7}", f"k{i % 3}") for i in range(101)}


def test_merged_lists_hold_every_row(spark, tmp_path):
    from airloom.plans import text

    sf = put(spark, tmp_path, "embeddings", [(i, i % 5) for i in range(50)], "vec_id long, label int")
    got = {(r.vec_id, r.label): (r.src, r.pos) for r in text.q47_merge_docs(spark, sf).collect()}
    assert got == {(i, i % 5): (1, 100000 - i) if i % 3 else (0, i) for i in range(50)}
