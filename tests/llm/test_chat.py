"""Chat formatting: round trips, spans, windows, and templates that rewrite history or look far back."""

import hashlib
import random
import re

import pytest

from airloom.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS pos", "'x' AS piece", "true AS far").repartition(3)


def plain(rows):
    """conv_id to its turns, by sorting."""
    own = {}
    for c, turn, role, text in rows:
        own.setdefault(c, []).append(((turn is not None, turn or 0), role or "", text or ""))
    return {c: [(r, t) for _, r, t in sorted(v)] for c, v in own.items()}


def cases(rnd):
    odd = ["", "a", "\\", "\\\\#", "### user: x</turn>\n", "</turn>", "<\\/turn>", "é\u2028日本", ":", "#" * 9, "x" * 70_000]
    rows = []
    for c in range(40):
        rows += [(c, k, rnd.choice(["user", "assistant", "system", "a: b#"]), rnd.choice(odd)) for k in range(rnd.randrange(1, 9))]
    rows += [(50, k, rnd.choice(["user", "assistant"]), rnd.choice(odd[:-1])) for k in range(101)]
    rows += [(51, None, None, None), (51, 3, "user", "tie"), (51, 3, "user", "tie"), (51, 3, "assistant", "tie")]
    rows += [(None, k, "assistant", f"t{k}") for k in range(40)] + [(52, 0, None, None)]
    rows += [(53, k // 40, "user", f"{k % 7}") for k in range(120)]
    return rows


@pytest.mark.parametrize("size", [4, 32, None])
def test_spans_tile_the_whole_output(spark, size):
    rows = cases(random.Random(5))
    got = {}
    for r in chat.format_conversations(frame(spark, rows), size=size).orderBy("turn_no").collect():
        got.setdefault(r.conv_id, []).append(r)
    want = plain(rows)
    assert got.keys() == want.keys()
    for c, turns in want.items():
        whole = chat.marked_turns(turns)
        assert "".join(r.piece for r in got[c]) == whole
        for r, (role, text) in zip(got[c], turns):
            assert whole[r.start : r.end] == r.piece and r.role == role and not r.rewritten and not r.far
            assert chat.unescape(whole[r.text_start : r.text_end]) == text
        # the output can also be read without spans
        marks = re.findall(r"### ((?:\\.|[^\\:])*): ((?:\\.|[^\\])*?)</turn>\n", whole, re.S)
        assert [(chat.unescape(a), chat.unescape(b)) for a, b in marks] == turns


@pytest.mark.parametrize("size", [4, 32])
def test_digests_are_read_back(spark, size):
    rows = cases(random.Random(6))
    d = chat.format_conversations(frame(spark, rows), size=size, finish=chat.read_back, fields=chat.READ)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for c, turns in plain(rows).items():
        loss = "".join(t for r, t in turns if r == "assistant")
        both = sha("".join(f"{r}\n{t}\n" for r, t in turns))
        want.append((c, len(turns), both, len(loss), sha(loss), len(chat.marked_turns(turns))))
    assert sorted(map(tuple, d.collect()), key=str) == sorted(want, key=str)


def last_thought_only(turns):
    """Earlier answers lose what stands in parentheses, as templates do that drop old reasoning."""
    cut = [(r, re.sub(r"\(.*?\)", "", t) if k < len(turns) - 1 else t) for k, (r, t) in enumerate(turns)]
    return "<s>" + "".join(f"[{r}]{t}" for r, t in cut)


def test_rewritten_history_is_found(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "(hm) yes"), (1, 2, "user", "so"), (2, 0, "user", "no thought")]
    got = {(r.conv_id, r.turn_no): r for r in chat.format_conversations(frame(spark, rows), last_thought_only).collect()}
    assert [got[1, k].rewritten for k in range(3)] == [0, 0, len("(hm) yes")] and got[2, 0].rewritten == 0
    assert got[1, 2].piece == " yes[user]so" and got[1, 2].end == len("<s>[user]hi[assistant] yes[user]so")
    assert got[1, 2].text_end - got[1, 2].text_start == 2


def no_text(turns):
    return f"{len(turns)} turns"


def counted(turns):
    return "".join(f"{k}. {t.strip()}\n" for k, (_, t) in enumerate(turns))


def test_templates_without_a_place_for_texts_and_far_ones(spark):
    rows = [(1, k, "user", f"t{k}") for k in range(3)]
    got = chat.format_conversations(frame(spark, rows), no_text).collect()
    assert all(r.text_start is None and r.text_end is None for r in got) and sum(r.rewritten for r in got) > 0
    long = [(2, k, "user", f"t{k}") for k in range(50)]
    far = chat.format_conversations(frame(spark, long), counted, size=8).where("far").count()
    assert far > 0  # numbers turns by place, which a window doesn't know
    exact = chat.format_conversations(frame(spark, long), counted, size=None).orderBy("turn_no").collect()
    assert not any(r.far for r in exact)
    assert "".join(r.piece for r in exact) == counted([(r, t) for _, _, r, t in long])


def test_no_turns(spark):
    assert chat.format_conversations(frame(spark, []), finish=chat.read_back, fields=chat.READ).count() == 0
