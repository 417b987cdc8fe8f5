"""Runs of over 50 words are cut wherever they start."""

import random

from airloom.llm import substring

from .test_operators import brute_cut, make, words


def test_runs_that_start_in_mid_sentence_are_cut(spark):
    rnd = random.Random(5)
    run, short = words(rnd, 51, 10**6), words(rnd, 50, 10**6)
    dotted = ". ".join(words(rnd, 20, 10**6) for _ in range(4))
    texts = [
        f"first own words {run} and more {short} of its own. {dotted} ends",
        f"{words(rnd, 40, 10**6)} {run.upper()} {words(rnd, 40, 10**6)}",
        f"other {short} words",
        f"starts\nelse {run.replace(' ', chr(10), 20)} here\nthen {dotted} goes on",
        words(rnd, 200, 10**6),
    ]
    got = {r.doc_id: r for r in substring.dedupe(make(spark, texts)).collect()}
    for i, want in enumerate(brute_cut(texts)):
        assert (got[i].text, [tuple(x) for x in got[i].removed]) == want
    assert got[1].text == texts[1].replace(run.upper() + " ", "") and [x.keeper for x in got[1].removed] == [0]
    assert got[3].text == "starts\nelse here\nthen goes on"
    assert all(got[i].text == texts[i] for i in (0, 2, 4))


def test_mixed_passages_equal_plain_strings(spark):
    rnd = random.Random(11)
    pool = [words(rnd, rnd.choice([20, 24, 25, 26, 40, 50, 51, 52, 70, 130]), 10**6) for _ in range(14)]
    texts = []
    for _ in range(90):
        parts = []
        for _ in range(rnd.randrange(0, 5)):
            p = rnd.choice(pool).split()
            if rnd.random() < 0.4:  # a part of a passage
                a = rnd.randrange(len(p))
                p = p[a : a + rnd.randrange(1, len(p) + 1)]
            parts.append(rnd.choice([" ", "  "]).join(p))
            parts.append(rnd.choice(["\n", " ", "\n\n", " own ", f" {words(rnd, 3, 10**6)} ", " \n "]))
        texts.append("".join(parts))
    texts += [rnd.choice(texts) for _ in range(10)] + [" ", "İ ß ſ " * 30, None]
    got = {r.doc_id: r for r in substring.dedupe(make(spark, texts)).collect()}
    for i, want in enumerate(brute_cut(texts)):
        if want is None:
            assert got[i].text is None and got[i].removed == []
            continue
        # blanks beside a cut may stay or go; words, offsets and keepers are fixed
        assert (i, got[i].text.split()) == (i, want[0].split()), texts[i]
        left, at = [], 0
        for start, end, _ in got[i].removed:
            left.append(texts[i][at:start])
            at = end
        assert "".join([*left, texts[i][at:]]) == got[i].text
        assert {k for _, _, k in got[i].removed} == {k for _, _, k in want[1]}
