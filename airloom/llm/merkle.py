"""Document fingerprints: Merkle trees over sections, lines and leaves of a few words, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, partitions, table

SECTION, LINE = "\n\n", "\n"
#: A leaf ends with a blank after one of these letters, digits and marks, which some 30 % of all words end with; a
#: longer one is cut every LEAF_CHARS characters.  So a leaf has a few words in texts of any length, and an edit changes
#: only the leaves around it.
LEAF_END, LEAF_CHARS = r"(?<=[oty0-9.!?;:,][ \t])", 64
IDS_PER_TASK = 200_000
#: Stands for a null doc_id in joins, and so the one doc_id that is returned as null.
NO_ID = -(2**63)


def leaf_pieces(line: Column) -> Column:
    """The leaves of a line, which joined give it again; none is empty."""
    words = F.filter(F.split(line, LEAF_END), lambda x: x != "")
    steps = lambda x: F.sequence(F.lit(1), F.length(x), F.lit(LEAF_CHARS))
    cut = lambda x: F.when(F.length(x) <= LEAF_CHARS, F.array(x)).otherwise(
        F.transform(steps(x), lambda i: F.substring(x, i, F.lit(LEAF_CHARS)))
    )
    # short lines have no long leaf, and few others do
    long = (F.length(line) > LEAF_CHARS) & F.exists(words, lambda x: F.length(x) > LEAF_CHARS)
    return F.when(long, F.flatten(F.transform(words, cut))).otherwise(words)


def tree(text: Column) -> Column:
    """Sections, split at blank lines, as arrays of their lines: each line's SHA-256 ``d`` and its leaves ``l``.

    Leaves are 32-bit digests of 8 hex digits each.  Sections and lines joined again by their breaks give the
    text, so the digests of all lines, grouped by section, tell texts apart.
    """
    # with the sign bit set a long has 16 digits, of which the last eight are the digest
    digest = lambda x: F.substring(F.hex(F.xxhash64(x).bitwiseOR(F.lit(-(2**63)))), 9, 8)
    line = lambda p: F.struct(F.sha2(p, 256).alias("d"), F.transform(leaf_pieces(p), digest).alias("l"))
    return F.transform(F.split(text, SECTION), lambda s: F.transform(F.split(s, LINE), line))


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """``df`` with the fingerprint ``root|section(line:n,...)/...|leaves`` of a text column.

    A section's digest is the SHA-256 of its lines' digests, the root that of the sections' digests, so equal
    roots mean equal texts.  Below the root digests are cut to 8 hex digits.  Each line has its number of
    leaves, and all leaves follow in the lines' order.  Lower-case hex throughout.
    """
    short = lambda d: F.substring(d, 1, 8)
    line = lambda p: F.concat(short(p["d"]), F.lit(":"), F.size(p["l"]).cast("string"))
    section = lambda s: F.struct(
        F.sha2(F.array_join(s["d"], ""), 256).alias("d"),
        F.array_join(F.transform(s, line), ",").alias("b"),
        F.array_join(F.flatten(s["l"]), "").alias("l"),
    )
    branch = lambda s: F.concat(short(s["d"]), F.lit("("), s["b"], F.lit(")"))
    s = F.col("__sections")
    root = F.sha2(F.array_join(s["d"], ""), 256)
    below = F.array_join(F.transform(s, branch), "/")
    parts = F.concat(root, F.lit("|"), below, F.lit("|"), F.array_join(s["l"], ""))
    out = df.withColumn("__sections", F.transform(tree(F.col(text)), section))
    return out.withColumn(name, F.lower(parts)).drop("__sections")


def leaves(fingerprint: Column) -> Column:
    """The leaves in a fingerprint, 8 hex digits each, joined."""
    return F.substring_index(fingerprint, "|", -1)


def likeness_of_leaves(a: Column, b: Column) -> Column:
    """Dice coefficient of the sets of leaves in two texts of ``leaves``; 1.0 if both are empty."""
    sets = [F.array_distinct(F.regexp_extract_all(x, F.lit("[0-9a-f]{8}"), F.lit(0))) for x in (a, b)]
    both = F.size(sets[0]) + F.size(sets[1])
    return F.when(both == 0, F.lit(1.0)).otherwise(2.0 * F.size(F.array_intersect(*sets)) / both)


def likeness(a: Column, b: Column) -> Column:
    """How alike two texts are by their fingerprints, from 0 to 1 (equal texts)."""
    return F.when(a == b, F.lit(1.0)).otherwise(likeness_of_leaves(leaves(a), leaves(b)))


def differences(a: Column, b: Column) -> Column:
    """Where two trees differ: (section, line) of those lines of ``a`` that ``b`` lacks, from 0, in order.

    Equal roots end the search, then only sections whose digest ``b`` lacks are entered, and in them only lines
    whose digest none of ``b``'s lines has.  ``differences(b, a)`` gives the other side.
    """
    sections = lambda x: F.split(F.split_part(x, F.lit("|"), F.lit(2)), "/")
    head = lambda s: F.substring(s, 1, 8)
    lines = lambda s: F.split(F.substring(s, F.lit(10), F.length(s) - 10), ",")
    theirs = F.transform(sections(b), head)
    known = F.flatten(F.transform(sections(b), lambda s: F.transform(lines(s), head)))
    entered = F.filter(
        F.transform(sections(a), lambda s, i: F.struct(i.alias("section"), s.alias("s"))),
        lambda x: ~F.array_contains(theirs, head(x["s"])),
    )
    found = F.flatten(
        F.transform(
            entered,
            lambda x: F.transform(
                lines(x["s"]),
                lambda p, j: F.struct(x["section"].alias("section"), j.alias("line"), head(p).alias("d")),
            ),
        )
    )
    changed = F.filter(found, lambda f: ~F.array_contains(known, f["d"]))
    out = F.transform(changed, lambda f: F.struct(f["section"].alias("section"), f["line"].alias("line")))
    return F.when(F.substring(a, 1, 64) == F.substring(b, 1, 64), F.slice(out, 1, 0)).otherwise(out)


def following(keys: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, previous) over distinct longs ``key`` in cyclic ascending order, without a single ordered task.

    Keys are dealt in ranges; the neighbour is found inside a range, and for each range's first key in
    a table of one row per range.
    """
    spark = keys.sparkSession
    n = max(partitions(spark), -(-keys.count() // IDS_PER_TASK))
    ranged = scratch.keep(keys.repartitionByRange(n, "key").withColumn("range", F.spark_partition_id()), "ranges")
    w = "OVER (PARTITION BY range ORDER BY key)"
    inner = ranged.selectExpr("*", f"lag(key) {w} AS previous")
    ends = ranged.groupBy("range").agg(F.max("key").alias("last"), F.min("key").alias("first"))
    ends = ends.selectExpr("range", "coalesce(lag(last) OVER (ORDER BY first), max(last) OVER ()) AS before")
    return inner.join(F.broadcast(ends), "range").select(
        *[c for c in ranged.columns if c != "range"], F.coalesce("previous", "before").alias("previous")
    )


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text of ``docs`` (doc_id, text) and of its edited text.

    The edited text has its last floor(n_chars/2) code points replaced by the first as many (or all)
    of the next document by ascending doc_id; after the last comes the first, and a single document
    follows itself.  Null texts are empty.  A null doc_id comes before all others.  Rows that repeat a
    doc_id each give a row; what follows them is the next other doc_id's text with the smallest
    XXH64.  An empty table gives an empty result; more columns are ignored.

    Ids alone are ordered; whole texts are dealt once by doc_id and their heads, with the leaves of their
    fingerprints, once to the document before.
    """
    scratch = Scratch(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("key"), text.alias("text"))
    ids = rows.groupBy("key").agg(F.min(F.xxhash64("text")).alias("pick"), F.max(F.length("text")).alias("chars"))
    ids = following(scratch.keep(ids, "ids"), scratch)
    follows = ids.select(F.col("previous").alias("key"), F.col("key").alias("next"))
    half = F.floor(F.col("chars") / 2).cast("int").alias("m")
    want = ids.select("key", "chars").join(follows, "key")
    want = want.select(F.col("next").alias("key"), F.col("key").alias("before"), half)
    want = scratch.keep(want.join(ids.select("key", "pick"), "key"), "order")

    heads = rows.join(want, "key").where(F.xxhash64("text").bitwiseXOR(F.col("pick")) == 0)
    heads = with_fingerprint(heads, "text", "fingerprint")
    head = F.substring(F.col("text"), F.lit(1), F.col("m")).alias("head")
    heads = heads.select(F.col("before").alias("key"), head, leaves(F.col("fingerprint")).alias("next_leaves"))
    heads = heads.dropDuplicates(["key"])
    n = F.length("text")
    cut = (n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("head"), F.lit(1), cut))
    out = rows.join(heads, "key").withColumn("edited", edited)
    out = with_fingerprint(with_fingerprint(out, "text", "fingerprint"), "edited", "edited_fingerprint")
    out = out.withColumn("leaves", leaves(F.col("fingerprint")))
    out = out.withColumn("edited_leaves", leaves(F.col("edited_fingerprint")))
    return out.select(
        F.nullif("key", F.lit(NO_ID)).alias("doc_id"),
        n.cast("long").alias("n_chars"),
        F.sha2(F.col("edited"), 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        likeness_of_leaves(F.col("leaves"), F.col("edited_leaves")).alias("near_edited"),
        likeness_of_leaves(F.col("leaves"), F.col("next_leaves")).alias("near_next"),
    )


def op10_document_fingerprints(spark, sf_dir: str) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents").select("doc_id", "text"))
