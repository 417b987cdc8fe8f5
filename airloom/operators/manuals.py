"""Manuals: header removal, sections, chunks, page ranges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import running

SHORT_LINE, REPEATED_SHARE = 80, 0.5
LEAST_WORDS = 30
STRETCH, PAGE_BLOCK = 4096, 10_000
LINE_END = "\r\n|\n|\r"
# Chunk sizes and overlaps in tokens: by default, and the least and greatest size.
CHUNK_TOKENS, OVERLAP_TOKENS = 800, 100
LEAST_TOKENS, MOST_TOKENS = 300, 2000
# Patterns and limits of headings.
NUMBERED = r"^\d+(\.\d+){0,4}[\).:-]?\s+\S+"
NAMED = r"^(section|chapter|appendix)\s+\w+"
TITLE = r"^[A-Za-z0-9 ,:/()\-]+$"
HEADING_CHARS, UPPER_SHARE, UPPER_WORDS, TITLE_SHARE, TITLE_WORDS = 120, 0.7, 12, 0.7, 10
# Words of a heading (or text) that decide a chunk's type, in the order of the tests.
PROCEDURE_WORDS = ("procedure", "steps", "startup", "shutdown")
CHECKLIST_WORDS = ("checklist", "check list")
DEFINITION_WORDS = ("definition", "glossary")
EQUATION_WORDS = ("equation", "formula")
EXAMPLE_WORDS = ("example", "case")


def page_lines(pages: DataFrame) -> DataFrame:
    """(doc_id, page_no, line_no, line): lines that aren't blank, trimmed."""
    lines = pages.select("doc_id", "page_no", F.posexplode(F.split("text", LINE_END)).alias("line_no", "line"))
    return lines.withColumn("line", F.trim("line")).where("line <> ''")


def repeated_lines(pages: DataFrame, share: float = REPEATED_SHARE) -> DataFrame:
    """(doc_id, line, pages): short lines on at least such a share of a document's pages."""
    n = pages.groupBy("doc_id").agg(F.count_distinct("page_no").alias("n_pages"))
    seen = page_lines(pages).where(F.length("line") <= SHORT_LINE).select("doc_id", "page_no", "line").distinct()
    c = seen.groupBy("doc_id", "line").agg(F.count("*").alias("pages"))
    return c.join(n, "doc_id").where(F.col("pages") / F.col("n_pages") >= share).select("doc_id", "line", "pages")


def clean_pages(pages: DataFrame) -> DataFrame:
    """Pages without repeated lines and page numbers; pages left without lines have empty text.

    A document has few repeated lines (at most twice a page's), so they come to its pages, which stay whole.
    """
    few = repeated_lines(pages).groupBy("doc_id").agg(F.collect_set("line").alias("__repeated"))
    lines = F.transform(F.split("text", LINE_END), lambda x: F.trim(x))
    none = F.array().cast("array<string>")
    kept = lambda x: (x != "") & ~x.rlike(r"^\d{1,4}$") & ~F.array_contains(F.coalesce("__repeated", none), x)
    text = F.coalesce(F.array_join(F.filter(lines, kept), "\n"), F.lit(""))
    return pages.join(few, "doc_id", "left").select("doc_id", "page_no", text.alias("text"))


def normal_space(text: Column) -> Column:
    t = F.regexp_replace(F.replace(text, F.lit(" "), F.lit(" ")), r"[ \t]+", " ")
    return F.regexp_replace(F.regexp_replace(t, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def is_heading(line: Column) -> Column:
    """Numbered, named, mostly upper-case or title-case short lines."""
    return _is_heading(F.trim(line))


def _is_heading(s: Column) -> Column:
    """The same of a trimmed line; cheap tests come first, and counts stand in for lists of words."""
    words = F.regexp_count(s, F.lit(r"\S+"))
    letters, upper = F.regexp_count(s, F.lit(r"\p{L}")), F.regexp_count(s, F.lit(r"\p{Lu}"))
    capital = F.regexp_count(s, F.lit(r"(?<!\S)\p{Lu}"))
    shout = (upper > 0) & (upper / F.greatest(letters, F.lit(1)) >= UPPER_SHARE) & (words <= UPPER_WORDS)
    title = s.rlike(TITLE) & (words <= TITLE_WORDS) & (capital / F.greatest(words, F.lit(1)) >= TITLE_SHARE)
    short = (F.length(s) > 0) & (F.length(s) <= HEADING_CHARS)
    return short & (s.rlike(NUMBERED) | F.lower(s).rlike(NAMED) | title | shout)


def text_sections(docs: DataFrame, text: str = "text") -> DataFrame:
    """(other columns, section, heading, body) of whole texts, folded inside each row: no exchange.

    A section starts at each heading; one without text goes, so a heading right after another takes
    its place.  ``section`` counts the headings up to it.
    """
    lines = F.filter(F.transform(F.split(text, LINE_END), lambda x: F.trim(x)), lambda x: x != "")
    d = docs.withColumn("__lines", lines).where(F.size("__lines") > 0)
    d = d.withColumn("__at", _places(F.transform("__lines", lambda x, i: F.when(_is_heading(x), i + 1))))
    return _fold(d, [c for c in docs.columns if c != text])


def _places(marks: Column) -> Column:
    return F.filter(marks, lambda i: i.isNotNull())


def _fold(d: DataFrame, kept: list[str]) -> DataFrame:
    """Sections of rows with the array ``__lines`` and the places of its headings, ``__at``.

    No function here looks into a computed array element by element, which would compute it anew for each.
    """
    n = F.size("__lines")
    bounds = F.transform(
        F.arrays_zip(F.concat(F.array(F.lit(0)), "__at").alias("a"), F.concat("__at", F.array(n + 1)).alias("b")),
        lambda x, k: F.struct(k.cast("long").alias("section"), x["a"].alias("a"), x["b"].alias("b")),
    )
    body = lambda x: F.array_join(F.slice("__lines", x["a"] + 1, x["b"] - x["a"] - 1), "\n")
    heading = lambda x: F.when(x["a"] > 0, F.try_element_at("__lines", x["a"])).otherwise("")
    sections = F.transform(
        bounds, lambda x: F.struct(x["section"].alias("section"), heading(x).alias("heading"), body(x).alias("body"))
    )
    # the outer form, since the inner one would compute the sections once more to filter by their number
    full = F.filter(sections, lambda x: x["body"] != "")
    return d.select(*kept, F.inline_outer(full)).where("section IS NOT NULL")


def sections(lines: DataFrame) -> DataFrame:
    """(doc_id, section, heading, body) from numbered lines (doc_id, line_no, line), as of ``text_sections``."""
    d = lines.where(F.trim("line") != "").withColumn("line", F.trim("line"))
    d = d.withColumn("h", is_heading(F.col("line")))
    d = d.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "line", "h"))).alias("__rows"))
    at = _places(F.transform("__rows", lambda r, i: F.when(r["h"], i + 1)))
    return _fold(d.withColumns({"__lines": F.col("__rows.line"), "__at": at}), ["doc_id"])


def words_for(tokens: int) -> int:
    return max(50, int(tokens / 1.3))


def word_chunks(df: DataFrame, text: str, chunk_tokens: int, overlap_tokens: int) -> DataFrame:
    """``chunk_no`` and ``chunk`` in place of a text: overlapping windows of words, the last one reaching the end.

    Chunks are cut before rows are multiplied, so no row carries the words of its whole text.  (The outer form of
    explode, since the inner one would compute the chunks once more to filter by their number.)
    """
    size = words_for(chunk_tokens)
    stride = max(1, size - min(size - 1, words_for(overlap_tokens)))
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    d = df.withColumn("__w", words).where(F.size("__w") > 0)
    n = F.greatest(F.lit(0), F.ceil((F.size("__w") - size) / stride)).cast("int")
    chunk = lambda i: F.array_join(F.slice("__w", i * stride + 1, F.lit(size)), " ")
    d = d.withColumn("__c", F.transform(F.sequence(F.lit(0), n), chunk)).drop("__w")
    return d.select(*[c for c in df.columns if c != text], F.posexplode_outer("__c").alias("chunk_no", "chunk"))


def chunk_type(heading: Column, text: Column) -> Column:
    h, t = F.lower(F.coalesce(heading, F.lit(""))), F.lower(F.coalesce(text, F.lit("")))
    words = F.size(F.filter(F.split(h, r"\s+"), lambda w: w != ""))
    has = lambda names: reduce(lambda a, b: a | b, [h.contains(x) for x in names])
    toc = h.contains("table of contents") | (F.trim(h) == "contents") | (h.contains("contents") & (words <= 3))
    return (
        F.when(toc, "toc")
        .when(h.contains("fault") & (h.contains("table") | t.contains("table")), "fault_table")
        .when(has(PROCEDURE_WORDS), "procedure")
        .when(has(CHECKLIST_WORDS), "checklist")
        .when(has(DEFINITION_WORDS), "definition")
        .when(has(EQUATION_WORDS), "equation")
        .when(has(EXAMPLE_WORDS), "case_example")
        .when(t.rlike(r"\bprocedure\b") & t.rlike(r"\bstep\b"), "procedure")
        .otherwise("general_section")
    )


def manual_chunks(
    docs: DataFrame, chunk_tokens: int = CHUNK_TOKENS, overlap_tokens: int = OVERLAP_TOKENS
) -> DataFrame:
    """(id, doc_id, section, chunk_no, chunk, chunk_type) from texts (doc_id, text) or numbered lines.

    Short sections stay as they are, others are cut in word windows; chunks under 30 words go.
    """
    from ..functions.scalars import token_estimate

    found = text_sections(docs.select("doc_id", "text")) if "text" in docs.columns else sections(docs)
    both = F.when(F.col("heading") != "", F.concat_ws("\n", "heading", "body")).otherwise(F.col("body"))
    s = found.withColumn("text", both).withColumn("__short", token_estimate(F.col("text")) <= chunk_tokens)
    whole = s.where("__short").withColumn("chunk_no", F.lit(0)).withColumn("chunk", F.col("text"))
    cut = word_chunks(s.where("NOT __short"), "text", chunk_tokens, overlap_tokens)
    out = whole.drop("text").unionByName(cut).withColumn("chunk_type", chunk_type(F.col("heading"), F.col("chunk")))
    out = out.where(F.regexp_count("chunk", F.lit(r"\S+")) >= LEAST_WORDS)
    i = F.row_number().over(Window.partitionBy("doc_id").orderBy("section", "chunk_no")) - 1
    name = F.concat(F.col("doc_id").cast("string"), F.lit("::chunk::"), i.cast("string"))
    return out.select(name.alias("id"), "doc_id", "section", "chunk_no", "chunk", "chunk_type")


def joined_pages(pages: DataFrame) -> DataFrame:
    """(doc_id, corpus): a document's pages, white space made single, in order with one blank between."""
    flat = F.trim(F.regexp_replace("text", r"\s+", " "))
    rows = F.array_sort(F.collect_list(F.struct("page_no", flat.alias("text"))))
    return pages.groupBy("doc_id").agg(F.array_join(F.transform(rows, lambda x: x["text"]), " ").alias("corpus"))


def chunk_positions(chunks: DataFrame, corpora: DataFrame) -> DataFrame:
    """``chunks`` (doc_id, chunk, ...) with ``start`` and ``end`` in the document's joined text; null where not found.

    A document's chunks are gathered beside its text, which is looked through for each in turn.
    """
    flat = F.trim(F.regexp_replace("chunk", r"\s+", " "))
    own = [c for c in chunks.columns if c != "doc_id"]
    per = chunks.groupBy("doc_id").agg(F.collect_list(F.struct(*own, flat.alias("__flat"))).alias("__chunks"))
    at = lambda c: F.when(c["__flat"] != "", F.nullif(F.position(c["__flat"], F.col("corpus")), F.lit(0)) - 1)
    found = F.transform("__chunks", lambda c: F.struct(c.alias("c"), at(c).cast("long").alias("start")))
    d = per.join(corpora, "doc_id", "left").select("doc_id", F.inline(found))
    end = F.col("start") + F.length("c.__flat")
    rest = [F.col(f"c.{c}").alias(c) if c != "doc_id" else F.col(c) for c in chunks.columns]
    return d.select(*rest, "start", end.alias("end"))


def page_spans(pages: DataFrame) -> DataFrame:
    """Each page's half-open span in the document's joined, space-normalised text.

    Lengths are summed by blocks of PAGE_BLOCK page numbers, so a document of very many pages is no single task.
    """
    flat = pages.withColumn("text", F.trim(F.regexp_replace("text", r"\s+", " ")))
    block = F.floor(F.col("page_no") / PAGE_BLOCK)
    out = running(flat, "doc_id", block, ["page_no"], F.length("text") + 1, F.sum)
    start = F.col("running")
    return out.withColumn("page_start", start).withColumn("page_end", start + F.length("text")).drop("running")


def page_range(spans: DataFrame, pieces: DataFrame) -> DataFrame:
    """First and last page of pieces (doc_id, piece, start, end) by overlap.

    Pages and pieces meet in stretches of STRETCH characters, so a document's pairs grow with its length, not its square."""
    at = lambda a, b: F.explode(
        F.sequence(F.floor(F.col(a) / STRETCH), F.floor(F.greatest(F.col(a), F.col(b) - 1) / STRETCH))
    )
    spans = spans.select("doc_id", "page_no", "page_start", "page_end", at("page_start", "page_end").alias("stretch"))
    j = pieces.withColumn("stretch", at("start", "end")).join(spans, ["doc_id", "stretch"]).where(
        (F.col("page_end") > F.col("start")) & (F.col("page_start") < F.col("end"))
    )
    return j.groupBy("doc_id", "piece").agg(F.min("page_no").alias("first_page"), F.max("page_no").alias("last_page"))


def indexed_chunks(
    pages: DataFrame, params: DataFrame | None = None, chunk_tokens: int = CHUNK_TOKENS, overlap_tokens: int = OVERLAP_TOKENS
) -> DataFrame:
    """(doc_id, chunk_index, section, chunk_no, heading, chunk, chunk_type, first_word, words, page_start, page_end).

    Chunks of whole manuals from their pages (doc_id, page_no, text), headers removed.  Lines stay rows: running
    sums give each its section and its first word's place there, so a line knows the windows of words that it meets
    and the pages come along; no manual and no section is ever one row, and no text is searched for.  ``params``
    (doc_id, size, overlap) has tokens for single manuals.  A section without headings anywhere in its manual keeps
    an empty line between pages, as the text it comes from.  Chunks under 30 words go; ``first_word`` counts in
    the section, heading included.
    """
    clean = clean_pages(pages).withColumn("text", normal_space(F.col("text")))
    lines = clean.select("doc_id", "page_no", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    lines = lines.withColumn("line", F.trim("line")).where("line <> ''")
    words = F.filter(F.split("line", r"\s+"), lambda w: w != "")
    lines = lines.withColumn("h", _is_heading(F.col("line"))).withColumn("n", F.regexp_count("line", F.lit(r"\S+")))
    block, order = F.floor(F.col("page_no") / PAGE_BLOCK), ["page_no", "line_no"]
    numbered = running(lines, "doc_id", block, order, F.col("h").cast("int"), F.sum, frame="here")
    numbered = numbered.withColumnRenamed("running", "section").withColumn(
        "own", F.concat_ws("|", F.col("section").cast("string"), F.col("doc_id").cast("string"))
    )
    placed = running(numbered, "own", block, order, F.col("n"), F.sum).withColumnRenamed("running", "at")
    of_section = numbered.groupBy("own").agg(
        F.sum("n").alias("total"),
        F.count_if(~F.col("h")).alias("bodies"),
        F.coalesce(F.max(F.when(F.col("h"), F.col("line"))), F.lit("")).alias("heading"),
    )
    plain = numbered.groupBy("doc_id").agg((~F.bool_or("h")).alias("plain"))
    d = placed.join(of_section.where("bodies > 0"), "own").join(plain, "doc_id")
    tokens, over = F.lit(chunk_tokens), F.lit(overlap_tokens)
    if params is not None:
        d = d.join(params.select("doc_id", F.col("size").alias("__size"), F.col("overlap").alias("__over")), "doc_id", "left")
        tokens, over = F.coalesce("__size", tokens), F.coalesce("__over", over)
    window = lambda t: F.greatest(F.lit(50), F.floor(t / 1.3)).cast("int")
    d = d.withColumn("size", window(tokens)).withColumn("whole", F.floor(F.col("total") * 1.3) <= tokens)
    d = d.withColumn("stride", F.greatest(F.lit(1), F.col("size") - F.least(F.col("size") - 1, window(over))))
    last = F.greatest(F.lit(0), F.ceil((F.col("total") - F.col("size")) / F.col("stride")))
    low = F.greatest(F.lit(0), F.ceil((F.col("at") - F.col("size") + 1) / F.col("stride")))
    high = F.least(last, F.floor((F.col("at") + F.col("n") - 1) / F.col("stride")))
    met = F.when(F.col("whole"), F.array(F.lit(0).cast("long"))).when(low <= high, F.sequence(low.cast("long"), high.cast("long")))
    d = d.withColumn("__words", words).withColumn("__met", F.coalesce(met, F.array().cast("array<long>")))

    def cut(c: Column) -> Column:
        start = F.greatest(F.lit(0), c * F.col("stride") - F.col("at"))
        end = F.least(F.col("n"), c * F.col("stride") + F.col("size") - F.col("at"))
        part = F.array_join(F.slice("__words", (start + 1).cast("int"), (end - start).cast("int")), " ")
        return F.struct(
            c.alias("chunk_no"),
            F.when(F.col("whole"), F.col("line")).otherwise(part).alias("part"),
            F.when(F.col("whole"), F.col("n")).otherwise(end - start).cast("long").alias("held"),
        )

    parts = d.select(
        *"doc_id section own heading plain whole page_no line_no stride".split(), F.inline(F.transform("__met", cut))
    )
    gathered = F.array_sort(F.collect_list(F.struct("page_no", "line_no", "part")))
    chunks = parts.groupBy("doc_id", "section", "chunk_no").agg(
        gathered.alias("rows"),
        F.sum("held").alias("words"),
        F.min("page_no").alias("page_start"),
        F.max("page_no").alias("page_end"),
        *(F.first(c).alias(c) for c in ("heading", "plain", "whole", "stride")),
    )
    gap = lambda r, i: F.when(i == 0, "").when(
        F.col("plain") & (r["page_no"] != F.try_element_at("rows", i)["page_no"]), "\n\n"
    ).otherwise("\n")
    lined = F.array_join(F.transform("rows", lambda r, i: F.concat(gap(r, i), r["part"])), "")
    text = F.when(F.col("whole"), lined).otherwise(F.array_join("rows.part", " "))
    chunks = chunks.where(F.col("words") >= LEAST_WORDS).withColumn("chunk", text)
    chunks = chunks.withColumn("chunk_type", chunk_type(F.col("heading"), F.col("chunk")))
    first = (F.col("chunk_no") * F.col("stride")).cast("long").alias("first_word")
    flat = chunks.select(
        "doc_id", "section", "chunk_no", "heading", "chunk", "chunk_type", first, "words", "page_start", "page_end"
    )
    out = running(flat, "doc_id", F.floor(F.col("section") / PAGE_BLOCK), ["section", "chunk_no"], F.lit(1), F.sum)
    return out.withColumnRenamed("running", "chunk_index")


# Fields of a manual that its chunks carry as they are, as a switch, and as a list in one text.
PLAIN_FIELDS = ("doc_id", "file_name", "authority", "doc_type", "ui_label", "citation_short")
SWITCHES = ("supports_diagnosis", "supports_resolution")
LIST_FIELDS = ("reasoning_role", "equipment_scope", "fault_types", "canonical_topics")


def manual_index(pages: DataFrame, metadata: DataFrame) -> DataFrame:
    """(id, document, metadata): the chunks of manuals as a vector collection takes them, embedding apart.

    ``pages``: file_name, page_no, text.  ``metadata``: one row a file, its fields, and chunk sizes that the manual
    recommends; files without are left out.  A list is joined by ``|``; a chunk's ``metadata`` has its 17 fields.
    """
    has = lambda c: F.col(c) if c in metadata.columns else F.lit(None).cast("string")
    size, over = bounded_chunk_params(
        has("recommended_chunk_size_tokens").cast("string"), has("recommended_overlap_tokens").cast("string")
    )
    params = metadata.select("doc_id", size.alias("size"), over.alias("overlap"))
    own = pages.join(metadata.select("file_name", "doc_id"), "file_name").select("doc_id", "page_no", "text")
    chunks = indexed_chunks(own, params)
    listed = lambda c: F.array_join(has(c), "|") if dict(metadata.dtypes).get(c, "").startswith("array") else has(c)
    known = [
        *(has(c).alias(c) for c in PLAIN_FIELDS),
        *(F.coalesce(has(c).cast("boolean"), F.lit(False)).alias(c) for c in SWITCHES),
        *(F.coalesce(listed(c), F.lit("")).alias(c) for c in LIST_FIELDS),
    ]
    d = chunks.join(metadata.select(*known), "doc_id")
    fields = [*PLAIN_FIELDS, *SWITCHES, *LIST_FIELDS, "chunk_index", "chunk_type", "page_start", "page_end"]
    name = F.concat_ws("::chunk::", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string"))
    whole = F.struct(*fields, F.lit("manual").alias("source"))
    return d.select(name.alias("id"), F.col("chunk").alias("document"), whole.alias("metadata"))


def bounded_chunk_params(size: Column, overlap: Column) -> tuple[Column, Column]:
    """Recommended sizes within the bounds; missing ones and texts that aren't numbers are the defaults."""
    own = F.coalesce(size.try_cast("int"), F.lit(CHUNK_TOKENS))
    s = F.greatest(F.lit(LEAST_TOKENS), F.least(F.lit(MOST_TOKENS), own))
    return s, F.greatest(F.lit(0), F.least(s - 1, F.coalesce(overlap.try_cast("int"), F.lit(OVERLAP_TOKENS))))


def attach_metadata(files: DataFrame, metadata: DataFrame) -> DataFrame:
    return files.join(metadata, "file_name")
