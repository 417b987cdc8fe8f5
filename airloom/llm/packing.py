"""Sequence packing as a cutting-stock problem solved by column generation."""

from __future__ import annotations

import os
import re
import zlib
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, frugal, table, text_batches

CAPACITY = 2048
END_ID = 1
#: Lengths are counted in classes of so many tokens (rounded up), so the linear program has CAPACITY / GRAIN rows at most.
GRAIN = 4
#: Column generation ends when the bound from its prices is this close (or half a sequence), or after so many columns.
GAP, MOST_COLUMNS = 1e-4, 1_500
#: Where the patterns leave more room than this share of all sequences, some documents are cut to fill it, in so many
#: rounds at most; cuts lie at multiples of BLOCK ids, for which checksums are at hand.
MOST_PADDING, ROUNDS, BLOCK = 0.01, 4, 64
#: A worker keeps the ids of so many chunks; when full, it forgets the half that came last (frequent chunks come early).
CACHED_CHUNKS = 250_000
_RUN = re.compile(r"[^a-zA-Z0-9À-ÖØ-öø-ÿ \n\t\r][.,]")
#: Chunks of printable ASCII and Latin letters, which no normalisation but lower case changes, and the tokenizer's own pattern for them.
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
#: Pieces of a class are ranked in so many shares at least, and in shares of about so many pieces.
LEAST_SALTS, PIECES_PER_SALT = 16, 50_000


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class ChunkEncoder:
    """Ids of whole texts by way of a cache of their blank-separated chunks.

    The tokenizer drops white space and never joins text across it, so a text's ids are its chunks'
    ids in a row.  Only space, tab and line ends separate chunks here, which its pattern counts as
    white space too.  Ids are little-endian unsigned 32-bit numbers.  A plain chunk is cut by the
    tokenizer's pattern and its words go straight to its byte-pair model; any other chunk is encoded
    whole.
    """

    def __init__(self, path: str):
        from tokenizers.pre_tokenizers import ByteLevel

        self.tok = _tokenizer(path)
        self.known: dict[str, bytes] = {"": b""}
        by_bytes = ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {c: by_bytes.pre_tokenize_str(chr(c))[0][0] for c in [*range(0xDF, 0xF7), *range(0xF8, 0x100)]}

    def __call__(self, texts: list[str]) -> list[bytes]:
        known, out = self.known, []
        for t in texts:
            split = chunks(t)
            ids = list(map(known.get, split))
            if None in ids:
                if len(known) > CACHED_CHUNKS:
                    self.known = known = dict(islice(known.items(), CACHED_CHUNKS // 2))
                known.update(zip(new := {c for c, i in zip(split, ids) if i is None}, map(self.encode, new)))
                ids = [known[c] if i is None else i for c, i in zip(split, ids)]
            out.append(b"".join(ids))
        return out

    def encode(self, chunk: str) -> bytes:
        if not _PLAIN.fullmatch(chunk):
            return np.array(self.tok.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()
        model = self.tok.model.tokenize
        words = _WORDS.findall(chunk.lower())
        return b"".join(
            [t.id.to_bytes(4, "little") for w in words for t in model(w if w.isascii() else w.translate(self.letters))]
        )


@lru_cache(maxsize=1)
def _encoder(path: str) -> ChunkEncoder:
    """One encoder and cache for all tasks of a worker."""
    return ChunkEncoder(path)


def chunks(text: str) -> list[str]:
    """A text's blank-separated chunks, points and commas apart from the word before them.

    The tokenizer ends a word before punctuation anyway, but keeps a run of punctuation together; texts
    with anything but Latin letters, digits and blanks before a point or comma stay as they are.  It lower-cases each character, which for
    ASCII is what lower() does.
    """
    if text.isascii():
        text = text.lower()
    if not _RUN.search(text):
        text = text.replace(",", " ,").replace(".", " .")
    return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, blocks): each document's ids and a last id 1, cut every ``capacity`` ids.

    ``blocks``: the checksums of each BLOCK ids of the piece, 4 bytes each.
    """

    @frugal
    def run(batches):
        encode = _encoder(tokenizer)
        end = np.array([END_ID], "<u4").tobytes()
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
        crc = zlib.crc32
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            at = 0
            while at < len(texts):
                stop, chars = at, 0
                while stop < len(texts) and (stop == at or chars + len(texts[stop] or "") < 2_000_000):
                    chars += len(texts[stop] or "")
                    stop += 1
                rows, blocks = [], []
                for i, raw in zip(ids[at:stop], encode([t or "" for t in texts[at:stop]])):
                    raw += end
                    n = len(raw) // 4
                    for s in range(0, n, capacity):
                        part = raw[4 * s : 4 * (s + capacity)]
                        rows.append((i, s, len(part) // 4, crc(part), n))
                        own = [crc(part[j : j + 4 * BLOCK]) for j in range(0, len(part), 4 * BLOCK)]
                        blocks.append(np.array(own, "<u4").tobytes())
                at = stop
                cols = [*(pa.array(c, pa.int64()) for c in zip(*rows)), pa.array(blocks, pa.binary())]
                yield pa.record_batch(cols, names=[*names, "blocks"])

    plain = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, blocks binary"
    return plain.mapInArrow(run, schema)


@lru_cache(maxsize=None)
def _zeros(n: int) -> tuple[int, ...]:
    """What ``n`` zero bytes do to a CRC-32, as the images of its bits (n: a power of two)."""
    if n == 1:
        images = []
        for bit in range(32):
            x = 1 << bit
            for _ in range(8):
                x = x >> 1 ^ (0xEDB88320 if x & 1 else 0)
            images.append(x)
        return tuple(images)
    half = _zeros(n // 2)
    return tuple(_apply(half, x) for x in half)


def _apply(images: tuple[int, ...], x: int) -> int:
    out, bit = 0, 0
    while x:
        if x & 1:
            out ^= images[bit]
        x >>= 1
        bit += 1
    return out


def joined_crc(parts: list[tuple[int, int]]) -> int:
    """The CRC-32 of bytes from that of their parts, each with its length."""
    total = 0
    for crc, size in parts:
        bit = 1
        while bit <= size:
            if size & bit:
                total = _apply(_zeros(bit), total)
            bit <<= 1
        total ^= crc
    return total


def cut_pieces(found: DataFrame) -> DataFrame:
    """Pieces with a ``step`` cut every so many ids (a multiple of BLOCK), others as they are."""

    @frugal
    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                step, n = r["step"] or r["length"], r["length"]
                own = np.frombuffer(r["blocks"], "<u4").tolist()
                sizes = [4 * min(BLOCK, n - j) for j in range(0, n, BLOCK)]
                for s in range(0, n, step):
                    some = slice(s // BLOCK, -(-min(s + step, n) // BLOCK))
                    crc = r["ids_crc32"] if step >= n else joined_crc(list(zip(own[some], sizes[some])))
                    rows.append((r["doc_id"], r["start"] + s, min(step, n - s), crc, r["doc_tokens"]))
            cols = [pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 5)]
            yield pa.record_batch(cols, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    plain = found.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "blocks", "step")
    return plain.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def invert(a: np.ndarray) -> np.ndarray:
    """The inverse by Gauss-Jordan elimination with row exchanges, in elementwise steps.

    The driver's process holds a JVM's gateway, where a threaded linear algebra library can block; sizes
    are a few hundred rows, so it isn't needed.
    """
    n = len(a)
    work = np.concatenate([a.astype(float), np.eye(n)], axis=1)
    for k in range(n):
        best = k + int(np.abs(work[k:, k]).argmax())
        if work[best, k] == 0:
            raise ValueError("no inverse")
        if best != k:
            work[[k, best]] = work[[best, k]]
        work[k] /= work[k, k]
        rows = np.flatnonzero(work[:, k])
        rows = rows[rows != k]
        work[rows] -= work[rows, k, None] * work[k]
    return work[:, n:]


def times(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Matrix times vector in elementwise steps."""
    own = np.flatnonzero(x)
    return (a[:, own] * x[own]).sum(axis=1)


def knapsack(value: np.ndarray, width: np.ndarray, capacity: int) -> np.ndarray:
    """Counts of the items (any number of each) of most value that fit: dynamic program over capacities."""
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    order = np.argsort(width, kind="stable")
    w, v = width[order], value[order]
    ends = np.searchsorted(w, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        best[c], pick[c] = best[c - 1], -1
        if k := ends[c]:
            got = best[c - w[:k]] + v[:k]
            j = int(got.argmax())
            if got[j] > best[c] + 1e-12:
                best[c], pick[c] = got[j], j
    count = np.zeros(len(width), np.int64)
    c = capacity
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            count[order[pick[c]]] += 1
            c -= int(w[pick[c]])
    return count


def first_basis(width: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Patterns filled largest first, each used until a width runs out: a triangular basis and its use."""
    m, order = len(width), np.argsort(-width, kind="stable")
    left, columns, x = demand.astype(float).copy(), np.zeros((m, m)), np.zeros(m)
    open_ = [int(i) for i in order]
    while open_:
        room, column = capacity, np.zeros(m)
        for i in open_:
            if room < width[i]:
                continue
            column[i] = room // width[i]
            room -= int(column[i]) * int(width[i])
        own = np.flatnonzero(column)
        use = (left[own] / column[own]).min()
        left[own] = np.maximum(left[own] - use * column[own], 0)
        gone = [int(i) for i in own if left[i] <= 1e-9 * demand[i]]
        columns[:, gone[0]], x[gone[0]] = column, use
        for i in gone[1:]:
            columns[i, i] = capacity // width[i]
        left[gone] = 0
        open_ = [i for i in open_ if i not in set(gone)]
    return columns, x


def cutting_stock(width: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[list[tuple[np.ndarray, int]], float]:
    """Patterns (counts per width) with how often each is used, covering ``demand`` exactly, and the bound on their number.

    The linear program min sum x, A x = demand is solved by the revised simplex method from a first
    fit's patterns; further columns are priced by the knapsack.  Patterns are used floor(x) times; what is left, fewer sequences than
    the program has rows, is packed largest first into whatever still fits.
    """
    m = len(width)
    columns, x = first_basis(width, demand, capacity)
    inverse = invert(columns)
    bound = (demand * width).sum() / capacity
    for step in range(MOST_COLUMNS):
        price = inverse.sum(axis=0)
        new = knapsack(np.maximum(price, 0), width, capacity)
        worth = float((price * new).sum())
        bound = max(bound, x.sum() / max(worth, 1.0))
        if worth <= 1 + 1e-9 or x.sum() - bound <= max(GAP * x.sum(), 0.5):
            break
        d = times(inverse, new)
        ratio = np.where(d > 1e-9, x / np.where(d > 1e-9, d, 1), np.inf)
        out = int(ratio.argmin())
        columns[:, out] = new
        pivot = inverse[out] / d[out]
        inverse -= d[:, None] * pivot
        inverse[out] = pivot
        x = np.maximum(x - ratio[out] * d, 0)
        x[out] = ratio[out]
        if step % 100 == 99:
            inverse = invert(columns)
            x = np.maximum(times(inverse, demand), 0)
    used, left = [], demand.astype(np.int64).copy()
    for j in np.argsort(-x, kind="stable"):
        column = columns[:, j].astype(np.int64)
        own = column > 0
        use = min(int(x[j] + 1e-9), int((left[own] // column[own]).min()))
        if use > 0:
            used.append((column, use))
            left -= use * column
    order = np.argsort(-width, kind="stable")
    while left.any():
        room, column = capacity, np.zeros(m, np.int64)
        for i in order:
            if left[i] and width[i] <= room:
                n = min(int(left[i]), room // int(width[i]))
                column[i] += n
                room -= n * int(width[i])
        own = column > 0
        use = int((left[own] // column[own]).min())
        used.append((column, use))
        left -= use * column
    return used, float(bound)


def plan(
    counts: dict[int, int], capacity: int, block: int
) -> tuple[list[tuple[int, int, int, int]], dict[int, int], list[tuple[dict[int, int], int]]]:
    """Cuts, the counts of widths after them, and patterns (counts by width) with how often each is used.

    Cuts are (width, first rank, end rank, step): so many pieces of a width are cut every ``step``.  Where
    patterns leave over MOST_PADDING of the room, sequences of a pattern with much room are taken apart, and
    their widest pieces cut to the room's size in the others; then patterns are sought anew.  Pieces are
    cut in one round only.
    """
    counts, whole, cuts = dict(counts), dict(counts), []
    first = dict.fromkeys(counts, 0)
    for _ in range(ROUNDS):
        width = np.array(sorted(w for w, n in counts.items() if n))
        used, _ = cutting_stock(width, np.array([counts[w] for w in width.tolist()], float), capacity)
        patterns = [({int(width[i]): int(c[i]) for i in np.flatnonzero(c)}, n) for c, n in used]
        room = sum(n for _, n in patterns) * capacity - sum(w * n for w, n in counts.items())
        most = MOST_PADDING * sum(n for _, n in patterns) * capacity
        if room <= max(most, capacity):
            break
        before = len(cuts)
        for own, n in patterns:
            step = (capacity - sum(w * k for w, k in own.items())) // block * block
            donors = [w for w in own if w > step and whole.get(w)]
            if not step or n < 2 or not donors:
                continue
            w = max(donors)
            apart = -(-n // (1 + w // step * own[w]))
            cut = min(apart * own[w], whole[w])
            cuts.append((w, first[w], first[w] + cut, step))
            first[w] += cut
            whole[w] -= cut
            counts[w] -= cut
            counts[step] = counts.get(step, 0) + cut * (w // step)
            if w % step:
                counts[w % step] = counts.get(w % step, 0) + cut
        if len(cuts) == before:
            break
    else:
        width = np.array(sorted(w for w, n in counts.items() if n))
        used, _ = cutting_stock(width, np.array([counts[w] for w in width.tolist()], float), capacity)
        patterns = [({int(width[i]): int(c[i]) for i in np.flatnonzero(c)}, n) for c, n in used]
    return cuts, counts, patterns


def _ranked(found: DataFrame, scratch: Scratch) -> DataFrame:
    """``found`` with its ``class`` and ``rank`` in it: by a salt and, within it, by id."""
    found = found.withColumn("class", F.ceil(F.col("length") / GRAIN).cast("int"))
    salts = max(LEAST_SALTS, -(-found.count() // PIECES_PER_SALT))
    found = found.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts)).cast("int"))
    by_salt = scratch.keep(found.groupBy("class", "salt").count(), "classes")
    before = by_salt.selectExpr(
        "class", "salt", "sum(count) OVER (PARTITION BY class ORDER BY salt) - count AS before"
    )
    order = "OVER (PARTITION BY class, salt ORDER BY doc_id, start, doc_tokens, ids_crc32)"
    ranked = found.selectExpr("*", f"row_number() {order} - 1 AS own").join(before, ["class", "salt"])
    return ranked.withColumn("rank", F.col("before") + F.col("own")).drop("before", "own", "salt")


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all ``docs`` (doc_id, text) in sequences of at most ``capacity`` tokens.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.  A document is cut
    every ``capacity`` ids; where lengths don't combine, some of what remains is cut again (see ``plan``).  The
    driver sees only the histogram of lengths (a bounded number of classes).  Pieces of a class are ranked
    without a common order, and ranks take the places that the patterns offer, so a length that
    a third of all documents has is dealt over tasks.  A null or empty text is its end id alone; rows
    that repeat a doc_id are packed each; no rows give no rows; more columns are ignored.
    """
    text_batches(docs.sparkSession)
    spark = docs.sparkSession
    scratch = Scratch(spark)
    found = scratch.keep(pieces(docs, tokenizer, capacity), "pieces")
    classes = found.groupBy(F.ceil(F.col("length") / GRAIN).cast("int").alias("class")).count()
    counts = {r["class"]: r["count"] for r in classes.collect()}
    cuts, counts, patterns = plan(counts, capacity // GRAIN, BLOCK // GRAIN) if counts else ([], {}, [])
    if cuts:
        steps = [(w, a, b, GRAIN * step) for w, a, b, step in cuts]
        steps = spark.createDataFrame(steps, "class int, low long, high long, step int")
        inside = (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
        ranked = _ranked(found, scratch)
        steps = steps.withColumnRenamed("class", "__class")
        chosen = ranked.join(F.broadcast(steps), (F.col("class") == F.col("__class")) & inside, "left")
        found = scratch.keep(cut_pieces(chosen), "cut")
    found = found.drop("blocks")
    places, base, slot = [], 0, dict.fromkeys(counts, 0)
    for own, use in patterns:
        for c, n in own.items():
            places.append((c, slot[c], slot[c] + n * use, n, base))
            slot[c] += n * use
        base += use
    places = spark.createDataFrame(places, "class int, low long, high long, each long, base long")
    ranked = _ranked(found, scratch)
    placed = ranked.join(F.broadcast(places), "class").where("rank >= low AND rank < high")
    placed = placed.withColumn("sequence_id", F.expr("base + (rank - low) div each"))
    line = "(PARTITION BY sequence_id ORDER BY class DESC, rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    placed = placed.selectExpr("*", f"sum(length) OVER {line} - length AS offset")
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), default_tokenizer())
