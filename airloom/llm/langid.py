"""Language identification with bit-sliced Bloom filters of character n-grams."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, table, text_batches

#: A trigram belongs to a language if it makes up this share of its trigrams, so none has more than 1 / LEAST_SHARE.
LEAST_SHARE = 2e-5
SLOT_BITS, PROBES = 21, 2
#: More distinct values of lang than this are taken for an error in the column.
MOST_LANGUAGES = 1_024
CHUNK = 1_000_000
FOLDS = 5
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def trigrams(text: str | None):
    """Arrays of the text's trigrams as 63-bit keys: three code points, all that aren't letters as one boundary.

    The middle one is a letter, so a word's first and last letters and short words are told apart.
    """
    if not text:
        return
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    for at in range(0, len(points) - 2, CHUNK):
        part = points[at : at + CHUNK + 2]
        letter = letters()[part]
        c = np.where(letter, part, 0).astype(np.uint64)
        yield ((c[:-2] << np.uint64(42)) | (c[1:-1] << np.uint64(21)) | c[2:])[letter[1:-1]]


def slots(keys: np.ndarray) -> list[np.ndarray]:
    return [((keys ^ (keys >> np.uint64(29))) * m) >> np.uint64(64 - SLOT_BITS) for m in _MULTIPLIERS[:PROBES]]


@dataclass(frozen=True)
class LanguageFilters:
    """Bit i of every slot is the Bloom filter of language i, so that one lookup serves all languages.

    ``table``: a row of machine words for each slot, one word for up to 64 languages.
    """

    languages: tuple[str, ...]
    table: np.ndarray

    def place(self, i: int) -> tuple[int, np.integer]:
        """The word of a slot that has language i's bit, and that bit."""
        kind = self.table.dtype.type
        width = 8 * kind().itemsize
        return i // width, kind(1 << i % width)

    def holding(self, mask: np.ndarray, i: int) -> np.ndarray:
        """Which masks have language i."""
        word, bit = self.place(i)
        return (mask[:, word] & bit) != 0

    def rates(self) -> np.ndarray:
        """Each language's false-positive rate, from how full its filter is."""
        full = [np.count_nonzero(self.holding(self.table, i)) for i in range(len(self.languages))]
        return (np.array(full) / len(self.table)) ** PROBES

    def contained(self, keys: np.ndarray) -> np.ndarray:
        """Masks of the languages that hold each trigram."""
        first, *more = slots(keys)
        mask = self.table[first]
        for s in more:
            mask = mask & self.table[s]
        return mask

    def predict(self, text: str | None, rates: np.ndarray) -> tuple[str, float]:
        """The language with the largest corrected share of trigrams (ties: by code point), and that share."""
        if not self.languages:
            return "und", 0.0
        n, hits = 0, np.zeros(len(self.languages), np.int64)
        for keys in trigrams(text):
            mask = self.contained(keys)
            n += len(keys)
            hits += [np.count_nonzero(self.holding(mask, i)) for i in range(len(self.languages))]
        if not n:
            return "und", 0.0
        share = np.clip((hits / n - rates) / np.maximum(1 - rates, 1e-9), 0, 1)
        best = int(np.argmax(share))
        return self.languages[best], float(share[best])


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % FOLDS


def learn(docs: DataFrame) -> LanguageFilters:
    """Filters from every row of ``docs`` (doc_id, text, lang) with a text, a language and a fold other than 0.

    Trigrams are counted in each task, summed by language and trigram, and those with LEAST_SHARE of
    their language's are kept: at most 1 / LEAST_SHARE rows for each language reach the driver.
    """
    text_batches(docs.sparkSession)
    rows = docs.where((fold(F.col("doc_id")) != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull())

    def count(batches):
        for batch in batches:
            parts: dict[str, list[np.ndarray]] = {}
            held = 0
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                for keys in trigrams(text.as_py()):
                    parts.setdefault(lang, []).append(keys)
                    held += len(keys)
                if held > 4 * CHUNK:
                    yield from emit(parts)
                    parts, held = {}, 0
            yield from emit(parts)

    def emit(parts):
        for lang, keys in parts.items():
            gram, n = np.unique(np.concatenate(keys), return_counts=True)
            yield pa.record_batch(
                {
                    "lang": pa.array([lang] * len(gram), pa.string()),
                    "gram": pa.array(gram.view(np.int64)),
                    "n": pa.array(n.astype(np.int64)),
                }
            )

    counted = rows.select(
        F.col("lang").cast("string"), F.col("text").cast("string")
    ).mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    scratch = Scratch(docs.sparkSession)
    counted = scratch.keep(counted, "trigrams")
    total = {
        r["lang"]: r["n"]
        for r in counted.groupBy("lang").agg(F.sum("n").alias("n")).orderBy("lang").limit(MOST_LANGUAGES + 1).collect()
    }
    if len(total) > MOST_LANGUAGES:
        raise ValueError(f"over {MOST_LANGUAGES} languages")
    names = tuple(sorted(total))
    least = F.create_map(*[F.lit(x) for k in names for x in (k, total[k] * LEAST_SHARE)]) if names else None
    frequent = counted.where(F.col("n") >= least[F.col("lang")]).select("lang", "gram").toPandas() if names else None
    scratch.drop(counted)
    # slots are as narrow as the languages allow, and have several words for over 64
    dtype = next((t for t in (np.uint8, np.uint16, np.uint32) if len(names) <= 8 * t().itemsize), np.uint64)
    words = max(1, -(-len(names) // (8 * dtype().itemsize)))
    filters = LanguageFilters(names, np.zeros((1 << SLOT_BITS, words), dtype))
    for i, lang in enumerate(names):
        word, bit = filters.place(i)
        for s in slots(frequent.gram[frequent.lang == lang].to_numpy(np.int64).view(np.uint64)):
            filters.table[s, word] |= bit
    return filters


def identify(docs: DataFrame, filters: LanguageFilters) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of ``docs`` (doc_id, text).

    A null text or one without letters is ``und`` with score 0, as is any if no language was learned.
    held_out: whether the row's fold is 0 (false without a doc_id; such rows aren't learned from
    either).  Repeated rows get equal results; no rows give no rows; more columns are ignored.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(filters)

    def run(batches):
        own = shared.value
        rates = own.rates() if own.languages else np.zeros(0)
        for batch in batches:
            got = [own.predict(t.as_py(), rates) for t in batch.column("text")]
            yield pa.record_batch(
                [
                    batch.column("doc_id"),
                    batch.column("held_out"),
                    pa.array([g[0] for g in got], pa.string()),
                    pa.array([g[1] for g in got], pa.float64()),
                ],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    plain = docs.select(
        F.col("doc_id").cast("long"),
        F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"),
        F.col("text").cast("string"),
    )
    return plain.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs.select("doc_id", "text"), learn(docs.select("doc_id", "text", "lang")))
