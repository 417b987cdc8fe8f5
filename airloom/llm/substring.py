"""Substring dedup: hashed texts and lines, and runs of words wherever they start."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, frugal, release_memory, table, text_batches

#: Texts and lines of fewer words are no units: headings and forms repeat without being copied.
LEAST_WORDS = 25
#: A run of so many words that an earlier document has goes wherever it starts and ends.
LONG_RUN = 51
#: Runs are sought by their anchor: of the digests of all GRAM words in a run, the smallest.
GRAM = 16
#: Texts are read in slices of about so many bytes.
SLICE = 4_000_000
_WORD = re.compile(r"\S+")
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """The lower-cased words of several texts as 64-bit digests in a row.

    Line i has the words from ``line[i]`` up to ``line[i + 1]``, text i the lines from ``text[i]`` up to
    ``text[i + 1]``.
    """

    digest: np.ndarray
    line: np.ndarray
    text: np.ndarray

    @classmethod
    def of(cls, texts: pa.Array) -> Words:
        words: list[str] = []
        sizes: list[int] = []
        counts: list[int] = []
        for text in texts.to_pylist():
            lines = text.lower().split("\n")
            counts.append(len(lines))
            for line in lines:
                own = line.split()
                sizes.append(len(own))
                words += own
        h = xxhash.xxh3_64_intdigest
        known = {w: h(w.encode("utf-8", "surrogatepass")) for w in set(words)}
        digest = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        line, text = (np.r_[0, np.cumsum(np.array(x, np.int64))] for x in (sizes, counts))
        return cls(digest, line, text)

    def text_words(self) -> np.ndarray:
        """The first word of each text, and the end."""
        return self.line[self.text]

    def units(self, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """128-bit digests, as two halves, of the word sequences between ``bounds``."""
        n = np.diff(bounds)
        place = (np.arange(len(self.digest)) - np.repeat(bounds[:-1], n)).astype(np.uint64)
        halves = []
        for seed in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
            term = _mix(self.digest ^ _mix(place * np.uint64(seed) + np.uint64(seed)))
            total = np.r_[np.zeros(1, np.uint64), np.cumsum(term, dtype=np.uint64)]
            halves.append(_mix(total[bounds[1:]] - total[bounds[:-1]] + n.astype(np.uint64) * _GOLD))
        return halves[0], halves[1]

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places from which LONG_RUN words of one text follow, and those runs' digests and anchors."""
        d = self.digest
        n = len(d) - LONG_RUN + 1
        if n <= 0:
            return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64)
        by = {1: d}
        for k in (1, 2, 4, 8, 16):
            by[2 * k] = _mix(by[k][:-k] * _GOLD + by[k][k:])
        digest, at = np.zeros(n, np.uint64), 0
        for k in (32, 16, 2, 1):  # LONG_RUN words
            digest = _mix(digest * _GOLD + by[k][at : at + n])
            at += k
        low, k = by[GRAM], 1
        while 2 * k <= LONG_RUN - GRAM + 1:
            low, k = np.minimum(low[:-k], low[k:]), 2 * k
        rest = LONG_RUN - GRAM + 1 - k
        anchor = np.minimum(low[:n], low[rest : rest + n])
        bounds = self.text_words()
        end = np.repeat(bounds[1:], np.diff(bounds))[:n]
        start = np.flatnonzero(np.arange(n) + LONG_RUN <= end)
        return start, digest[start], anchor[start]


def slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Bounds of slices of about SLICE bytes."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    at = total = 0
    for i, n in enumerate(size.tolist()):
        if total and total + n > SLICE:
            yield at, i
            at, total = i, 0
        total += n
    if at < len(size):
        yield at, len(size)


#: Kinds of rows in ``unit_digests``: a text or line, an anchor, and a text that repeats a line of its own.
UNIT, ANCHOR, REPEATS = 0, 1, 2


def unit_digests(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, kind, hi, lo): digests of each text and its lines, anchors of its runs (hi 0), marks of own repeats.

    ``docs``: doc_id, fp, text, none of them null.
    """

    @frugal
    def run(batches):
        for batch in batches:
            for a, b in slices(batch.column("text")):
                part = batch.slice(a, b - a)
                yield emit(
                    part.column("doc_id").to_numpy(), part.column("fp").to_numpy(), Words.of(part.column("text"))
                )

    def emit(ids, fps, words):
        rows = []
        size = np.diff(words.line)
        hi, lo = words.units(words.line)
        of_line = np.repeat(np.arange(len(ids)), np.diff(words.text))
        own = np.flatnonzero(size >= LEAST_WORDS)
        rows.append((of_line[own], UNIT, hi[own], lo[own]))
        order = own[np.lexsort((lo[own], hi[own], of_line[own]))]
        same = (of_line[order][1:] == of_line[order][:-1]) & (hi[order][1:] == hi[order][:-1])
        again = np.unique(of_line[order][1:][same & (lo[order][1:] == lo[order][:-1])])
        rows.append((again, REPEATS, np.zeros(len(again), np.uint64), np.zeros(len(again), np.uint64)))
        bounds = words.text_words()
        hi, lo = words.units(bounds)
        own = np.flatnonzero((np.diff(bounds) >= LEAST_WORDS) & (np.diff(words.text) > 1))
        rows.append((own, UNIT, hi[own], lo[own]))
        start, _, anchor = words.runs()
        of = np.searchsorted(bounds, start, side="right") - 1
        new = np.r_[True, (of[1:] != of[:-1]) | (anchor[1:] != anchor[:-1])] if len(of) else np.empty(0, bool)
        rows.append((of[new], ANCHOR, np.zeros(int(new.sum()), np.uint64), anchor[new]))
        at = np.concatenate([r[0] for r in rows]).astype(np.int64)
        kind = np.concatenate([np.full(len(r[0]), r[1], np.int8) for r in rows])
        halves = [np.concatenate([r[k] for r in rows]).view(np.int64) for k in (2, 3)]
        return pa.record_batch(
            [pa.array(x) for x in (ids[at], fps[at], kind, *halves)], names=["doc_id", "fp", "kind", "hi", "lo"]
        )

    return docs.mapInArrow(run, "doc_id long, fp long, kind byte, hi long, lo long")


def run_digests(anchored: DataFrame) -> DataFrame:
    """(doc_id, fp, lo): digests of the runs of LONG_RUN words whose anchor is among ``anchors``.

    ``anchored``: doc_id, fp, text, anchors and copied (low halves of the lines and of the text that an
    earlier document has).  Equal runs have equal anchors, so no run that two documents have is left out; a
    run inside one copied line or text is, since the first document that has that unit lists it.
    """

    @frugal
    def run(batches):
        for batch in batches:
            for a, b in slices(batch.column("text")):
                part = batch.slice(a, b - a)
                words = Words.of(part.column("text"))
                start, digest, anchor = words.runs()
                bounds = words.text_words()
                of = np.searchsorted(bounds, start, side="right") - 1
                line = np.searchsorted(words.line, start, side="right") - 1
                inside = start + LONG_RUN <= words.line[line + 1]
                whole, lines = words.units(bounds)[1], words.units(words.line)[1]
                ids, fps = part.column("doc_id").to_numpy(), part.column("fp").to_numpy()
                cuts = np.searchsorted(of, np.arange(len(part) + 1))
                out: list[tuple[np.ndarray, ...]] = []
                for i, (anchors, copied) in enumerate(zip(part.column("anchors"), part.column("copied"))):
                    here = slice(cuts[i], cuts[i + 1])
                    done = copied.values.to_numpy().view(np.uint64) if copied.is_valid else np.empty(0, np.uint64)
                    if whole[i] in done:
                        continue
                    known = anchors.values.to_numpy().view(np.uint64)
                    ok = np.isin(anchor[here], known) & ~(inside[here] & np.isin(lines[line[here]], done))
                    own = np.unique(digest[here][ok]).view(np.int64)
                    out.append((np.full(len(own), ids[i]), np.full(len(own), fps[i]), own))
                if out:
                    cols = [pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out)]
                    yield pa.record_batch(cols, names=["doc_id", "fp", "lo"])

    return anchored.mapInArrow(run, "doc_id long, fp long, lo long")


def cut(text: str, earlier: dict[int, int]) -> tuple[str, list[tuple[int, int, int | None]]]:
    """The text without copies, and the removed (start, end, keeper) with original offsets.

    ``earlier`` maps the low digest half of units and runs that an earlier document has to that document;
    a line repeated inside the text is kept once (keeper None).
    """
    words = Words.of(pa.array([text], pa.string()))
    whole = int(words.units(words.text_words())[1].view(np.int64)[0])
    if len(words.digest) >= LEAST_WORDS and whole in earlier:
        return "", [(0, len(text), earlier[whole])]
    gone: list[tuple[int, int, int | None]] = []
    own, at = set(), 0
    digests = words.units(words.line)[1].view(np.int64).tolist()
    for line, size, digest in zip(text.split("\n"), np.diff(words.line).tolist(), digests):
        start, end = at, min(at + len(line) + 1, len(text))
        at += len(line) + 1
        if size < LEAST_WORDS:
            continue
        if digest in earlier or digest in own:
            gone.append((start, end, earlier.get(digest)))
        own.add(digest)
    gone = sorted([*gone, *_outside(text, gone, _copied_runs(text, words, earlier))], key=lambda g: g[:2])
    keep, at = [], 0
    for start, end, _ in gone:
        keep.append(text[at:start])
        at = end
    return "".join([*keep, text[at:]]), gone


def _copied_runs(text: str, words: Words, earlier: dict[int, int]) -> list[tuple[int, int, int]]:
    """(start, end, keeper) of the runs of words that ``earlier`` has, with the blanks up to the next word of the line."""
    start, digest, _ = words.runs()
    hits = [(i, earlier[d]) for i, d in zip(start.tolist(), digest.view(np.int64).tolist()) if d in earlier]
    spans = [m.span() for m in _WORD.finditer(text)] if hits else []
    runs: list[list[int]] = []
    for i, k in hits:
        if runs and i <= runs[-1][1]:
            runs[-1][1] = i + LONG_RUN
        else:
            runs.append([i, i + LONG_RUN, k])
    out = []
    for a, b, k in runs:
        end = spans[b][0] if b < len(spans) else len(text)
        blank = text[spans[b - 1][1] : end]
        out.append((spans[a][0], spans[b - 1][1] if "\n" in blank else end, k))
    return out


def _outside(
    text: str, gone: list[tuple[int, int, int | None]], runs: list[tuple[int, int, int]]
) -> list[tuple[int, int, int]]:
    """The parts of ``runs`` with words that aren't in ``gone``; both are in order."""
    out, j = [], 0
    for a, b, k in runs:
        while j < len(gone) and gone[j][1] <= a:
            j += 1
        i = j
        while a < b:
            s, e = gone[i][:2] if i < len(gone) else (b, b)
            if text[a : min(s, b)].strip():
                out.append((a, min(s, b), k))
            a, i = max(a, e), i + 1
    return out


def dedupe(docs: DataFrame) -> DataFrame:
    """``docs`` with copies cut from ``text``, and ``removed``: array of (start, end, keeper).

    A unit is a text or a line of LEAST_WORDS or more words, in lower case with single blanks, or any
    LONG_RUN words in a row.  Of equal units the one in the smallest doc_id, and there the first, stays; the
    rest go (a run repeated inside one text stays).  Digests are grouped with partial sums; only units of
    several documents come back, joined by digest and then by document.  Runs of words are digested only
    around anchors that several documents have and outside lines that go anyway.

    Null texts stay null; rows without doc_id stay whole and take nothing from others; rows that repeat a
    doc_id are one document and don't take from each other, and each text of it is gathered apart.  Shorter
    texts than LEAST_WORDS never change.  An empty table gives an empty result; other columns pass, but for
    a column named ``removed``, which is replaced.
    """
    text_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession)
    text = F.col("text").cast("string")
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("fp"), text.alias("text"))
    plain = plain.where("doc_id IS NOT NULL AND text IS NOT NULL")
    seen = scratch.keep(unit_digests(plain), "units")
    bounds = [F.min("doc_id").alias("keeper"), F.max("doc_id").alias("last")]
    shared = seen.where(F.col("kind") != REPEATS).groupBy("kind", "hi", "lo").agg(*bounds).where("keeper < last")
    flagged = seen.join(shared.drop("last"), ["kind", "hi", "lo"]).where(f"kind = {ANCHOR} OR keeper < doc_id")
    repeats = seen.where(F.col("kind") == REPEATS).withColumn("keeper", F.lit(None).cast("long"))
    of_kind = lambda k, c: F.collect_set(F.when(F.col("kind") == k, c))
    own = flagged.unionByName(repeats).groupBy("doc_id", "fp").agg(
        of_kind(UNIT, F.struct("lo", "keeper")).alias("units"),
        of_kind(ANCHOR, F.col("lo")).alias("anchors"),
        (F.max("kind") == REPEATS).alias("repeats"),
    )
    own = scratch.keep(own, "shared")
    scratch.drop(seen)
    wanted = own.where("size(anchors) > 0").select("doc_id", "fp", "anchors", F.col("units.lo").alias("copied"))
    wanted = plain.join(wanted, ["doc_id", "fp"]).select(*plain.columns, "anchors", "copied")
    runs = scratch.keep(run_digests(wanted), "runs")
    first = runs.groupBy("lo").agg(*bounds).where("keeper < last").select("lo", "keeper")
    more = runs.join(first, "lo").where("keeper < doc_id")
    more = more.groupBy("doc_id", "fp").agg(F.collect_set(F.struct("lo", "keeper")).alias("runs"))
    # anchors alone change nothing
    changed = own.join(more, ["doc_id", "fp"], "left")
    changed = changed.where("size(units) > 0 OR repeats OR runs IS NOT NULL")
    units = F.concat("units", F.coalesce("runs", F.array()))
    changed = changed.select(F.col("doc_id").alias("__doc"), F.col("fp").alias("__fp"), units.alias("__u"))
    changed = changed.select("__doc", "__fp", F.col("__u.lo").alias("__lo"), F.col("__u.keeper").alias("__keeper"))

    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("keeper", pa.int64())])

    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, lows, keepers in batches:
            out, removed = [], []
            for t, a, b in zip(texts, lows, keepers):
                clean, gone = cut(t.as_py(), dict(zip(a.as_py(), b.as_py()))) if t.is_valid else (None, [])
                out.append(clean)
                removed.append([{"start": s, "end": e, "keeper": k} for s, e, k in gone])
            cols = [pa.array(out, pa.string()), pa.array(removed, pa.list_(span))]
            yield pa.StructArray.from_arrays(cols, names=["text", "removed"])
        release_memory()

    udf = F.arrow_udf(run, "text string, removed array<struct<start:long, end:long, keeper:long>>")
    same = (F.col("doc_id").cast("long") == F.col("__doc")) & (F.xxhash64(text) == F.col("__fp"))
    joined = docs.drop("removed").join(changed, same, "left")
    touched = F.col("__lo").isNotNull()
    joined = joined.withColumn("__cut", udf(F.when(touched, text), "__lo", "__keeper"))
    clean = F.when(touched, F.col("__cut.text")).otherwise(text).alias("text")
    cols = [clean if c == "text" else F.col(c) for c in docs.columns if c != "removed"]
    return joined.select(*cols, F.col("__cut.removed").alias("removed"))


def without_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with copies cut; n_chars follows the text, and documents of which nothing but white space is left go."""
    out = dedupe(docs).where("size(removed) = 0 OR text RLIKE '\\\\S'")
    if "n_chars" in docs.columns:
        now = F.when(F.size("removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", now)
    return out.select(docs.columns)


def op9_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedupe(docs).withColumn("n_removed", F.size("removed"))
