"""Toxicity severity by cumulative-link ordinal regression on sparse text features."""

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, frugal, release_memory, table, text_batches

#: At most so many labelled rows are fitted on: those with the smallest hash of doc_id.
SAMPLE_ROWS = 12_000
#: A feature has a weight if toxic and clean texts differ in it by this likelihood ratio, and it is so many times as
#: frequent among toxic ones.
LEAST_RATIO, LEAST_LIFT = 15.0, 4.0
PREFIXES = (4, 5, 6)
L2 = 2e-5
_WORD = re.compile(r"\w+")


def counts(text: str | None) -> Counter:
    """Lower-cased words and how often each stands in the whole text."""
    return Counter(_WORD.findall(text.lower())) if text else Counter()


def features(words: Counter) -> Counter:
    """Occurrences of words and, marked by ``*``, of their first 4, 5 and 6 characters (inflected stems)."""
    out = Counter(words)
    for w, n in words.items():
        for k in PREFIXES:
            if len(w) > k:
                out[w[:k] + "*"] += n
    return out


@dataclass(frozen=True)
class OrdinalModel:
    """P(grade > k) = logistic(w.x - threshold[k]): one weight vector for all ordered thresholds."""

    weights: dict[str, float]
    thresholds: tuple[float, ...]

    def score(self, words: Counter) -> float:
        get, found = self.weights.get, Counter()
        for w, n in words.items():
            if get(w) is not None:
                found[w] += n
            for k in PREFIXES:
                if len(w) > k and (f := w[:k] + "*") in self.weights:
                    found[f] += n
        return sum(self.weights[f] * (1 + np.log(n)) for f, n in sorted(found.items()))

    def exceed(self, score: np.ndarray) -> np.ndarray:
        """Probabilities of grades over 0, 1, ...; their sum is the expected grade."""
        z = score[:, None] - np.array(self.thresholds, float)[None, :]
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def loss(
    x: np.ndarray, row: np.ndarray, col: np.ndarray, value: np.ndarray, grade: np.ndarray, n_features: int, l2: float
) -> tuple[float, np.ndarray]:
    """Penalised mean negative log-likelihood of grades, and its gradient.

    ``x``: the weights, the first threshold, and the logarithms of the gaps to the next ones, so thresholds
    increase.  Features are sparse: row, column and value.
    """
    n, k = len(grade), len(x) - n_features
    w, t = x[:n_features], x[n_features] + np.r_[0, np.cumsum(np.exp(x[n_features + 1 :]))]
    s = np.bincount(row, w[col] * value, n)
    lower = np.c_[np.ones(n), 1 / (1 + np.exp(-np.clip(s[:, None] - t, -60, 60))), np.zeros(n)]  # P(grade >= j)
    at = np.arange(n)
    p = np.maximum(lower[at, grade] - lower[at, grade + 1], 1e-12)
    d = lower * (1 - lower)
    ds = -(d[at, grade] - d[at, grade + 1]) / p / n
    dt = np.bincount(grade, d[at, grade] / p / n, k + 2) + np.bincount(grade + 1, -d[at, grade + 1] / p / n, k + 2)
    tail = np.cumsum(dt[1 : k + 1][::-1])[::-1]
    slope = np.bincount(col, ds[row] * value, n_features) + 2 * l2 * w
    return -np.log(p).mean() + l2 * (w * w).sum(), np.r_[slope, tail[0], tail[1:] * np.exp(x[n_features + 1 :])]


def fit(
    row: np.ndarray, col: np.ndarray, value: np.ndarray, grade: np.ndarray, n_features: int, l2: float = L2, steps: int = 300
) -> tuple[np.ndarray, np.ndarray]:
    """Weights and increasing thresholds that maximise the penalised likelihood, by L-BFGS from zero."""
    k = int(grade.max())
    above = np.array([(grade > j).mean() for j in range(k)])
    start = np.log((1 - above) / np.maximum(above, 1e-6))
    gaps = np.log(np.maximum(np.diff(start), 1e-2))
    x = np.r_[np.zeros(n_features), start[0], gaps]
    dot = lambda a, b: float((a * b).sum())  # no threaded library in the driver
    at = lambda x: loss(x, row, col, value, grade, n_features, l2)

    f, g = at(x)
    memory: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        q, alphas = g.copy(), []
        for s, y in reversed(memory):
            alphas.append(dot(s, q) / dot(s, y))
            q -= alphas[-1] * y
        if memory:
            s, y = memory[-1]
            q *= dot(s, y) / dot(y, y)
        for (s, y), a in zip(memory, reversed(alphas)):
            q += s * (a - dot(y, q) / dot(s, y))
        step = 1.0 if memory else min(1.0, 1 / max(np.abs(g).max(), 1e-12))
        while step > 1e-10:
            new = x - step * q
            f2, g2 = at(new)
            if f2 <= f - 1e-4 * step * dot(g, q):
                break
            step /= 2
        else:
            break
        s, y = new - x, g2 - g
        if dot(s, y) > 1e-12:
            memory = [*memory[-9:], (s, y)]
        done = abs(f - f2) < 1e-9
        x, f, g = new, f2, g2
        if done:
            break
    return x[:n_features], x[n_features] + np.r_[0, np.cumsum(np.exp(x[n_features + 1 :]))]


def train(
    docs: DataFrame,
    labels: DataFrame,
    sample_rows: int = SAMPLE_ROWS,
    least_ratio: float = LEAST_RATIO,
    least_lift: float = LEAST_LIFT,
) -> OrdinalModel:
    """Fit on at most ``sample_rows`` labelled documents (labels: doc_id, toxic and, if there, quality).

    The ordered grades are those of the labels: 0 for good texts, 1 for poor ones (of low quality but not
    toxic), 2 for toxic ones.  Null toxic labels are left out; a doc_id labelled twice is toxic if any label says
    so, and poor if any says so; without quality labels there are two grades.  Of rows that repeat a doc_id
    the text with the smallest hash counts, so the bound holds.  Without labels of both kinds the model has no
    weight and finds nothing toxic.  The driver gets the features that tell the kinds apart (``least_ratio``,
    ``least_lift``) and, for each sampled row, the counts of those it has.
    """
    text_batches(docs.sparkSession)
    spark = docs.sparkSession
    none = OrdinalModel({}, (60.0,))
    poor = F.col("quality") <= 0 if "quality" in labels.columns else F.lit(False)
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(
        F.col("doc_id").cast("long").alias("doc_id")
    )
    low = F.max(F.coalesce(poor, F.lit(False)))
    known = known.agg((F.max("toxic") > 0).alias("toxic"), low.alias("poor"))
    known = known.withColumn("grade", F.when(F.col("toxic"), 2).when(F.col("poor"), 1).otherwise(0))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows).select("doc_id", "toxic", "grade")
    scratch = Scratch(spark)
    sample = scratch.keep(sample, "labels")
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("text IS NOT NULL")
    rows = rows.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "toxic", "grade")
    rows = rows.agg(F.min_by("text", F.xxhash64("text")).alias("text")).drop("doc_id")
    rows = scratch.keep(rows, "labelled")
    if rows.isEmpty():
        scratch.drop(sample, rows)
        return none

    @frugal
    def count(batches):
        sums: dict[str, list[int]] = {}
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                for f in features(counts(text)):
                    sums.setdefault(f, [0, 0])[toxic] += 1
            if len(sums) > 300_000:
                yield emit(sums)
                sums = {}
        yield emit(sums)

    def emit(sums):
        return pa.record_batch(
            {
                "feature": pa.array(list(sums), pa.string()),
                "clean": pa.array([v[0] for v in sums.values()], pa.int64()),
                "toxic": pa.array([v[1] for v in sums.values()], pa.int64()),
            }
        )

    n = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n1, n0 = n.get(True, 0), n.get(False, 0)
    if not n1 or not n0:
        scratch.drop(sample, rows)
        return none
    seen = rows.mapInArrow(count, "feature string, clean long, toxic long").groupBy("feature").agg(
        F.sum("clean").alias("c"), F.sum("toxic").alias("t")
    )
    share = n1 / (n0 + n1)
    term = lambda a, e: F.when(
        F.col(a) > 0, F.col(a) * F.log(F.col(a) / ((F.col("t") + F.col("c")) * e))
    ).otherwise(0.0)
    ranked = seen.where("t >= 3").withColumn("ratio", 2 * (term("t", share) + term("c", 1 - share)))
    ranked = ranked.where((F.col("ratio") >= least_ratio) & (F.col("t") / n1 >= least_lift * F.col("c") / n0))
    names = [r["feature"] for r in ranked.orderBy(F.desc("ratio"), "feature").select("feature").collect()]
    if not names:
        scratch.drop(sample, rows)
        return none
    index = {f: i for i, f in enumerate(names)}

    @frugal
    def project(batches):
        for batch in batches:
            ids, occ = [], []
            for text in batch.column("text").to_pylist():
                own = {index[f]: c for f, c in features(counts(text)).items() if f in index}
                ids.append(list(own))
                occ.append(list(own.values()))
            cols = {"ids": pa.array(ids, pa.list_(pa.int32())), "occ": pa.array(occ, pa.list_(pa.int32()))}
            yield pa.record_batch({"grade": batch.column("grade"), **cols})

    got = rows.mapInArrow(project, "grade int, ids array<int>, occ array<int>").toPandas()
    scratch.drop(sample, rows)
    order = sorted(range(len(got)), key=lambda i: (int(got.grade[i]), sorted(zip(got.ids[i], got.occ[i]))))
    got = got.iloc[order]
    grade = got.grade.to_numpy(np.int64)
    grade = np.searchsorted(np.unique(grade), grade)  # no empty grade
    row = np.repeat(np.arange(len(got)), [len(x) for x in got.ids])
    col = np.concatenate([np.asarray(x, np.int64) for x in got.ids])
    value = 1 + np.log(np.concatenate([np.asarray(x, float) for x in got.occ]))
    w, t = fit(row, col, value, grade, len(names))
    return OrdinalModel({f: float(x) for f, x in zip(names, w) if abs(x) > 1e-6}, tuple(float(x) for x in t))


def score(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """(doc_id, severity, p_toxic, grade, toxic, level) for every row of ``docs`` (doc_id, text).

    severity is the expected grade on the labels' scale, level the number of thresholds more likely passed than
    not; p_toxic is the probability of the last threshold, above which the toxic grade lies, toxic whether it is
    more likely passed than not, and grade the same as 0 or 1.  Null and empty texts have no feature and so the
    least severity.  Texts of any length count whole.  Repeated rows get equal results; an empty table gives
    none; more columns are ignored.
    """

    @frugal
    def run(batches):
        for batch in batches:
            s = np.array([model.score(counts(t.as_py())) for t in batch.column("text")], float)
            p = model.exceed(s)
            toxic = p[:, -1] >= 0.5
            cols = {
                "doc_id": batch.column("doc_id"),
                "severity": pa.array(p.sum(axis=1)),
                "p_toxic": pa.array(p[:, -1]),
                "grade": pa.array(toxic.astype(np.int32)),
                "toxic": pa.array(toxic),
                "level": pa.array((p >= 0.5).sum(axis=1).astype(np.int32)),
            }
            yield pa.record_batch(cols)

    plain = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return plain.mapInArrow(run, "doc_id long, severity double, p_toxic double, grade int, toxic boolean, level int")


def reject_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``docs`` that aren't toxic, all columns as they are; no shuffle after training."""
    model = train(docs, labels)

    def toxic(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            s = np.array([model.score(counts(t)) for t in texts.to_pylist()], float)
            yield pa.array(model.exceed(s)[:, -1] >= 0.5)
        release_memory()

    return docs.where(~F.arrow_udf(toxic, "boolean")(F.col("text").cast("string")))


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
