"""Token counts of documents and their sections by offset mapping."""

from __future__ import annotations

import base64
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table


@lru_cache(maxsize=2)
def _encoding(path: str, pattern: str):
    """The encoder and each id's length in bytes."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    length = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, i in ranks.items():
        length[i] = len(token)
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), length


def line_starts(text: str) -> list[int]:
    """Sections are lines with their line breaks; a text's last line break opens no further one."""
    starts, at = [0], text.find("\n")
    while 0 <= at < len(text) - 1:
        starts.append(at + 1)
        at = text.find("\n", at + 1)
    return starts


def attribute(token_bytes: np.ndarray, section_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and how many of them cross a boundary.

    Both inputs tile the same bytes: token lengths, and the sections' first bytes from 0.  A token
    inside one section counts there; one that crosses boundaries counts whole for the section that has
    most of its bytes (ties: the earliest).
    """
    end = np.cumsum(token_bytes)
    start = end - token_bytes
    first = np.searchsorted(section_starts, start, side="right") - 1
    last = np.searchsorted(section_starts, end - 1, side="right") - 1
    n = len(section_starts)
    count = np.bincount(first[first == last], minlength=n)
    crossing = np.zeros(n, np.int64)
    for t in np.flatnonzero(first != last):
        edges = np.r_[start[t], section_starts[first[t] + 1 : last[t] + 1], end[t]]
        crossing[first[t] + int(np.diff(edges).argmax())] += 1
    return count + crossing, crossing


def token_counts(
    docs: DataFrame, tokenizer: str, pattern: str, sections: Callable[[str], list[int]] = line_starts
) -> DataFrame:
    """(doc_id, section, start, end, tokens, crossing, doc_tokens): a row for every section of ``docs`` (doc_id, text).

    Each text is encoded once and whole, so tokens sum to doc_tokens; ids that split a character or
    join sections are attributed by their bytes (see ``attribute``).  ``sections`` gives the sections'
    first code points, from 0; start and end are code points of the text.  A null or empty text is
    one empty section with no token.  Rows that repeat a doc_id each give their rows; no rows give no
    rows; more columns are ignored.  There is no shuffle.
    """

    def run(batches):
        encoder, length = _encoding(tokenizer, pattern)
        for batch in batches:
            rows: list[list[np.ndarray]] = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                text = text.as_py() or ""
                ids = encoder.encode_ordinary(text)
                at = np.array(sections(text), np.int64)
                raw = at if text.isascii() else np.cumsum(
                    [0] + [len(text[a:b].encode("utf-8")) for a, b in zip(at[:-1], at[1:])]
                )
                n, crossing = attribute(length[ids], raw)
                rows.append(
                    [
                        [doc] * len(at),
                        np.arange(len(at)),
                        at,
                        np.r_[at[1:], len(text)],
                        n,
                        crossing,
                        np.full(len(at), len(ids)),
                    ]
                )
                if len(rows) >= 5000:
                    yield emit(rows)
                    rows = []
            if rows:
                yield emit(rows)

    def emit(rows):
        ids = pa.array([i for r in rows for i in r[0]], pa.int64())
        return pa.record_batch(
            [ids] + [pa.array(np.concatenate([r[k] for r in rows]).astype(np.int64)) for k in range(1, 7)],
            names=["doc_id", "section", "start", "end", "tokens", "crossing", "doc_tokens"],
        )

    plain = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return plain.mapInArrow(
        run, "doc_id long, section long, start long, end long, tokens long, crossing long, doc_tokens long"
    )


def op2_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    )
