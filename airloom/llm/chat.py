"""Chat formatting: prefixes go through a template that is a black box, and their differences place each turn."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import running
from ..staging import Scratch
from .common import frugal, table, text_batches

#: Turns whose prefixes are rendered from the first one on; a longer conversation is cut into windows of so many.
WINDOW = 32
#: Turns before a window that are rendered ahead of it, besides the conversation's first.
CONTEXT = 2

Turn = tuple[str, str]

SPANS = (
    "conv_id long, turn_no long, role string, piece string, start long, end long, text_start long, text_end long, "
    "rewritten long, far boolean"
)
PLACED = (
    "conv_id long, pos long, audit boolean, role string, piece string, text_start long, text_end long, rewritten long"
)
READ = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
)


def escape(text: str) -> str:
    """``text`` without a turn mark: number signs, backslashes and the slash of ``</turn>`` get a backslash."""
    return text.replace("\\", "\\\\").replace("#", "\\#").replace("</turn>", "<\\/turn>")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def marked_turns(turns: list[Turn]) -> str:
    """The query's template: ``### role: text</turn>`` and a line end for each turn."""
    return "".join("### {}: {}</turn>\n".format(escape(r).replace(":", "\\:"), escape(t)) for r, t in turns)


def role_of(head: str) -> str:
    """The role that stands in what ``marked_turns`` writes before a text."""
    return unescape(head.removeprefix("### ").removesuffix(": "))


def shared(a: str, b: str) -> int:
    """Length of the common prefix, by bisection over comparisons of whole slices."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a.startswith(b[low:mid], low):
            low = mid
        else:
            high = mid - 1
    return low


def place(render: Callable[[list[Turn]], str], turns: list[Turn], known: int = 0) -> Iterator[tuple]:
    """(piece, text_start, text_end, rewritten) of each turn behind the first ``known`` ones.

    A turn's piece is what its prefix' output has behind the part that it shares with the output before;
    ``rewritten`` counts the characters of that earlier output which changed.  The turn rendered with two
    different letters for its text shows where the text begins and how much follows it; both are null where
    the output doesn't have the text in one place.  Offsets are those in the piece.
    """
    before = render(turns[:known]) if known else ""
    for k in range(known, len(turns)):
        now = render(turns[: k + 1])
        keep = len(before) if now.startswith(before) else shared(before, now)
        one, two = (render([*turns[:k], (turns[k][0], letter)]) for letter in "ab")
        at = shared(one, two)
        tail = one[at + 1 :]
        found = len(one) == len(two) > at >= keep and tail == two[at + 1 :]
        found = found and len(now) >= at + len(tail) and now.startswith(one[:at]) and now.endswith(tail)
        ends = (at - keep, len(now) - len(tail) - keep) if found else (None, None)
        yield now[keep:], *ends, len(before) - keep
        before = now


def groups(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[list[dict]]:
    """Rows of sorted batches, one list for each key."""
    last, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            now = tuple(row[c] for c in key)
            if rows and now != last:
                yield rows
                rows = []
            last = now
            rows.append(row)
    if rows:
        yield rows


def whole(rows: list[dict], render) -> Iterator[tuple]:
    """A short conversation's placed turns."""
    for k, found in enumerate(place(render, [(r["role"], r["text"]) for r in rows])):
        yield rows[k]["conv_id"], k, False, rows[k]["role"], *found


def window(rows: list[dict], render, size: int) -> Iterator[tuple]:
    """A window's placed turns, and for comparison the first turn of the next one."""
    first = rows[0]["block"] * size
    known = sum(r["pos"] < first for r in rows)
    for r, found in zip(rows[known:], place(render, [(r["role"], r["text"]) for r in rows], known)):
        yield r["conv_id"], r["pos"], r["pos"] >= first + size, r["role"], *found


def spanned(placed: Iterator[tuple]) -> Iterator[tuple]:
    """Placed turns, sorted, with their offsets in the whole output; nothing is kept but the last turn's end."""
    here, total, audited = None, 0, None
    for conv, pos, audit, role, piece, a, b, rewritten in placed:
        if audit:
            audited = conv, pos, piece
            continue
        if pos == 0 or here != (conv,):
            here, total = (conv,), 0
        start = total - rewritten
        total = start + len(piece)
        ends = (None, None) if a is None else (start + a, start + b)
        yield conv, pos, role, piece, start, total, *ends, rewritten, bool(
            audited and audited[:2] == (conv, pos) and audited[2] != piece
        )


def out(rows: Iterator[tuple], fields: str) -> Iterator[pa.RecordBatch]:
    """Batches of at most 2,000 rows or some 8 million characters."""
    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    schema = pa.schema([(n, kinds[k]) for n, k in (f.split() for f in fields.split(", "))])
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(v) for v in row if isinstance(v, str))
        if len(held) >= 2_000 or size > 8_000_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


def format_conversations(
    conversations: DataFrame,
    render: Callable[[list[Turn]], str] = marked_turns,
    size: int | None = WINDOW,
    finish: Callable[[Iterator[tuple]], Iterator[tuple]] | None = None,
    fields: str = SPANS,
) -> DataFrame:
    """Every turn's piece of the formatted conversation, with its span and its text's in the whole output.

    ``render`` maps (role, text) pairs to a string and may do anything with them.  Columns: conv_id, turn_no
    from 0, role, piece, start, end, text_start, text_end, rewritten (characters of the output before that the
    turn changed: over 0, the template rewrites history), far.  Turns are ordered by turn, null first, ties by
    role and text; null roles and texts are empty; repeated rows are turns; rows without conv_id are one
    conversation; no rows give none; other columns are ignored.

    A conversation of more than ``size`` turns is cut into windows, rendered after its first turn and the two
    before the window, so one of any length is spread over tasks; ``far`` marks a turn whose piece came out
    otherwise in the window before, as a template's does that looks farther back.  For such a template ``size``
    None renders all prefixes whole.  ``finish`` takes the rows (sorted by conversation) to others with
    ``fields``.
    """
    text_batches(conversations.sparkSession)
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")),
    )
    finish = finish or (lambda spans: spans)
    order = ["conv_id", "turn", "role", "text"]

    @frugal
    def short(batches):
        placed = (t for own in groups(batches, ["conv_id"]) for t in whole(own, render))
        yield from out(finish(spanned(placed)), fields)

    if size is None:
        return rows.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(short, fields)

    @frugal
    def windows(batches):
        yield from out((t for own in groups(batches, ["conv_id", "block"]) for t in window(own, render, size)), PLACED)

    @frugal
    def joined(batches):
        names = [f.split()[0] for f in PLACED.split(", ")]
        placed = (tuple(r[c] for c in names) for batch in batches for r in batch.to_pylist())
        yield from out(finish(spanned(placed)), fields)

    counts = rows.groupBy(F.col("conv_id").alias("long_id")).agg(F.count("*").alias("turns")).where(F.col("turns") > size)
    # a table's size is known before texts would be shuffled for the join: a short one is broadcast
    counts = Scratch(conversations.sparkSession).keep(counts, "long")
    same = F.col("conv_id").eqNullSafe(F.col("long_id"))
    done = rows.join(counts, same, "left_anti").repartition("conv_id").sortWithinPartitions(*order)
    # a null id gets a name of its own while rows are numbered, as equi-joins on it lose it
    named = F.coalesce(F.col("conv_id").cast("string"), F.lit("none")).alias("id")
    long = rows.join(counts, same).select("conv_id", named, "turn", "role", "text", "turns")
    turn_block = F.coalesce(F.floor(F.col("turn") / 1024), F.lit(-(1 << 62)))
    long = running(long, "id", turn_block, ["turn", "role", "text"], F.lit(1), F.sum, frame="rows")
    long = long.select("conv_id", F.col("running").alias("pos"), "role", "text", "turns")
    block, last = F.expr(f"pos DIV {size}"), F.expr(f"(turns - 1) DIV {size}")
    to = F.when(F.col("pos") == 0, F.sequence(F.lit(0).cast("long"), last)).when(
        F.col("pos") % size == 0, F.array(block - 1, block)  # the window before renders it too
    )
    to = to.when((F.col("pos") % size >= size - CONTEXT) & (block < last), F.array(block, block + 1))
    long = long.select("conv_id", "pos", "role", "text", F.explode(F.coalesce(to, F.array(block))).alias("block"))
    long = long.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "pos").mapInArrow(windows, PLACED)
    long = long.repartition("conv_id").sortWithinPartitions("conv_id", "pos", F.desc("audit"))
    return done.mapInArrow(short, fields).unionByName(long.mapInArrow(joined, fields))


def read_back(spans: Iterator[tuple]) -> Iterator[tuple]:
    """Digests of each conversation's roles and texts, read from what ``marked_turns`` wrote, turn by turn."""
    here = None
    for conv, pos, _, piece, start, end, text_start, text_end, _, _ in spans:
        if pos == 0:
            if here:
                yield ended(here)
            here = {"conv": conv, "n": 0, "turns": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "end": 0}
        role = role_of(piece[: text_start - start])
        text = unescape(piece[text_start - start : text_end - start])
        here["n"], here["end"] = here["n"] + 1, end
        here["turns"].update(f"{role}\n{text}\n".encode())
        if role == "assistant":  # the loss mask: text_start to text_end of these turns
            here["chars"] += len(text)
            here["loss"].update(text.encode())
    if here:
        yield ended(here)


def ended(c: dict) -> tuple:
    return c["conv"], c["n"], c["turns"].hexdigest(), c["chars"], c["loss"].hexdigest(), c["end"]


TRAP = "\\### Assistant: </turn> ok"


def op11_chat_formatting(spark, sf_dir: str) -> DataFrame:
    """Digests go through a conversation's pieces in order, as SHA-256 must; all else is spread by windows."""
    trap = spark.createDataFrame(
        [(-7, 0, "user", TRAP), (-7, 1, "assistant", TRAP)], "conv_id long, turn long, role string, text string"
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(trap)
    return format_conversations(rows, finish=read_back, fields=READ)


_escaped = r"replace(replace(replace({}, '\', '\\'), '#', '\#'), '</turn>', '<\/turn>')"
OP11_SQL = rf"""
WITH c AS (SELECT conv_id, turn, role, text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '{TRAP}' UNION ALL SELECT -7, 1, 'assistant', '{TRAP}'),
t AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(r || chr(10) || x || chr(10), '' ORDER BY turn NULLS FIRST, r, x)) AS turns_sha256,
       coalesce(sum(length(x)) FILTER (r = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(x, '' ORDER BY turn NULLS FIRST, r, x) FILTER (r = 'assistant'), '')) AS loss_sha256,
       sum(14 + length(replace({_escaped.format("r")}, ':', '\:')) + length({_escaped.format("x")}))::BIGINT
         AS formatted_chars
FROM t GROUP BY conv_id
"""
