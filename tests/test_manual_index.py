"""The manual index against the plain way: sections, windows and pages of whole manuals."""

import random
import re

import pytest

from airloom.operators import manuals

from .test_engine import rows


def is_heading(s):
    words = s.split()
    letters = [c for c in s if c.isalpha()]
    if not s or len(s) > 120:
        return False
    if re.match(r"^\d+(\.\d+){0,4}[\).:-]?\s+\S+", s) or re.match(r"^(section|chapter|appendix)\s+\w+", s.lower()):
        return True
    if letters and sum(c.isupper() for c in letters) / len(letters) >= 0.7 and len(words) <= 12:
        return True
    title = re.fullmatch(r"[A-Za-z0-9 ,:/()\-]+", s) and len(words) <= 10
    return bool(title and sum(w[0].isupper() for w in words) / len(words) >= 0.7)


def plain_chunks(pages, tokens, overlap):
    """(section, chunk_no, heading, text, first page, last page) of one manual's pages in order."""
    lines = [[ln.strip() for ln in re.split("\r\n|\n|\r", p or "")] for p in pages]
    often = {s for s in {x for p in lines for x in p} if s and len(s) <= 80 and sum(s in p for p in lines) / len(pages) >= 0.5}
    clean = [[re.sub(r"[ \t]+", " ", s) for s in p if s and s not in often and not re.fullmatch(r"\d{1,4}", s)] for p in lines]
    flat = [(n, s) for n, p in enumerate(clean) for s in p]
    headed = any(is_heading(s) for _, s in flat)
    parts, number = [], 0
    current = [("", [])]
    for n, s in flat:
        if is_heading(s):
            number += 1
            current.append((s, [(n, s)]))
        else:
            current[-1][1].append((n, s))
    out = []
    size, over = max(50, int(tokens / 1.3)), max(50, int(overlap / 1.3))
    stride = max(1, size - min(size - 1, over))
    for section, (heading, held) in enumerate(current):
        if not any(not is_heading(s) for _, s in held):
            continue
        words = [(n, w) for n, s in held for w in s.split()]
        if int(len(words) * 1.3) <= tokens:
            text = ""
            for i, (n, s) in enumerate(held):
                between = "" if not i else "\n\n" if not headed and held[i - 1][0] != n else "\n"
                text += between + s
            out.append((section, 0, heading, text, words[0][0], words[-1][0]))
            continue
        i = k = 0
        while i < len(words):
            part = words[i : i + size]
            out.append((section, k, heading, " ".join(w for _, w in part), part[0][0], part[-1][0]))
            if i + size >= len(words):
                break
            i, k = i + stride, k + 1
    return [c for c in out if len(c[3].split()) >= 30]


@pytest.mark.parametrize("headings", [True, False])
def test_indexed_chunks_equal_the_plain_way(spark, monkeypatch, headings):
    monkeypatch.setattr(manuals, "PAGE_BLOCK", 3)
    rnd = random.Random(headings)
    body = lambda n: " ".join(rnd.choice(["valve", "the", "sensor", "drifts", "a", "step"]) for _ in range(n))
    heads = ["1.2 Overview", "SECTION 3", "Fault Table", "STARTUP STEPS"] if headings else ["the plain line"]
    data, want = [], {}
    for doc in ("m1", "m2", "m3"):
        pages = []
        for p in range(11):
            lines = ["Header of All Pages", str(p)] if doc != "m3" else []
            for _ in range(rnd.randrange(0, 6)):
                lines.append(rnd.choice(heads) if rnd.random() < 0.3 else body(rnd.choice([3, 20, 90, 400])))
            pages.append("\n".join(lines) if p != 5 else rnd.choice(["", None]))
        data += [(doc, p, t) for p, t in enumerate(pages)]
        want[doc] = plain_chunks(pages, 320 if doc == "m2" else 400, 100)
    d = spark.createDataFrame(data, "doc_id string, page_no int, text string")
    params = spark.createDataFrame([("m2", 320, 100)], "doc_id string, size int, overlap int")
    got = manuals.indexed_chunks(d, params, 400, 100)
    for doc, chunks in want.items():
        own = got.where(f"doc_id = '{doc}'").orderBy("chunk_index").collect()
        assert [r.chunk_index for r in own] == list(range(len(chunks)))
        assert [(r.section, r.chunk_no, r.heading, r.chunk, r.page_start, r.page_end) for r in own] == chunks
    assert sum(map(len, want.values())) > 10


def test_an_index_has_all_fields_and_skips_files_without_metadata(spark):
    pages = spark.createDataFrame([("a.pdf", 1, "word " * 40), ("b.pdf", 1, "word " * 40)], "file_name string, page_no int, text string")
    meta = spark.createDataFrame(
        [("D", "a.pdf", "guild", True, ["x", "y"], None)],
        "doc_id string, file_name string, authority string, supports_diagnosis boolean, fault_types array<string>, canonical_topics array<string>",
    )
    got = manuals.manual_index(pages, meta).collect()
    assert [r.id for r in got] == ["D::chunk::0"] and len(got[0].metadata) == 17
    m = got[0].metadata
    assert (m.fault_types, m.canonical_topics, m.supports_diagnosis, m.supports_resolution) == ("x|y", "", True, False)
    assert (m.page_start, m.page_end, m.source, m.chunk_type, m.ui_label) == (1, 1, "manual", "general_section", None)
    assert manuals.manual_index(pages.where("false"), meta).count() == 0
    assert rows(manuals.clean_pages(spark.createDataFrame([("d", 1, None)], "doc_id string, page_no int, text string")), "text") == [("",)]
