"""Vector retrieval, merging of hits, and window history documents."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import compact_text, general, to_timestamp

#: The sides of a block of pairs.
ROW_BLOCK, QUERY_BLOCK = 4_096, 2_048


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x
    )


def with_unit(df: DataFrame, embedding: str = "embedding") -> DataFrame:
    """The vector scaled to length one, so that a distance is one less a product."""
    n = F.nullif(F.sqrt(dot(F.col(embedding), F.col(embedding))), F.lit(0.0))
    return df.withColumn("unit", F.when(n.isNotNull(), F.transform(embedding, lambda x: x.cast("double") / n)))


def knn(collection: DataFrame, queries: DataFrame, k: int, where: Column | None = None) -> DataFrame:
    """Each query's k nearest rows by cosine distance to nine digits (ties: by id), exactly.

    Blocks of queries meet blocks of rows, each pair of blocks in one group of bounded size, of which
    k rows a query go on.  Null and zero vectors neither ask nor answer.
    Columns: collection (vec_id, embedding, ...), queries (query_id, query_embedding)."""
    rows = with_unit(collection.where(where) if where is not None else collection).drop("embedding")
    asked = with_unit(
        queries.select("query_id", F.col("query_embedding").alias("embedding"))
    ).select("query_id", F.col("unit").alias("qu"))
    rows, asked = rows.where("unit IS NOT NULL"), asked.where("qu IS NOT NULL")
    # counts of all rows will do for the number of blocks, and need no vectors
    kept_rows = collection.where(where) if where is not None else collection
    n, m = (max(1, -(-d.count() // size)) for d, size in ((kept_rows, ROW_BLOCK), (queries, QUERY_BLOCK)))
    every = lambda c: F.explode(F.sequence(F.lit(0), F.lit(c - 1)))
    block = lambda key, c: F.pmod(F.xxhash64(key), F.lit(c)).cast("int")
    left = asked.select("*", block("query_id", m).alias("__q"), every(n).alias("__r"))
    right = rows.select("*", block("vec_id", n).alias("__r"), every(m).alias("__q"))
    kept = [f for f in rows.schema.fields if f.name != "unit"]
    names = [f.name for f in kept]

    def nearest(asked: pa.Table, rows: pa.Table) -> pa.Table:
        at, of, far = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
        rows = rows.sort_by("vec_id") if len(rows) else rows
        dims = pc.list_value_length(rows["unit"]).to_numpy()
        for d in np.unique(pc.list_value_length(asked["qu"]).to_numpy()):
            own = np.flatnonzero(dims == d)
            who = np.flatnonzero(pc.list_value_length(asked["qu"]).to_numpy() == d)
            if not len(own):
                continue
            x = np.stack(rows["unit"].take(pa.array(own)).to_numpy())
            for a in range(0, len(who), 256):
                some = who[a : a + 256]
                dist = 1 - np.stack(asked["qu"].take(pa.array(some)).to_numpy()) @ x.T
                best = np.lexsort((np.broadcast_to(own, dist.shape), np.round(dist, 9)), axis=1)[:, :k]
                at.append(np.repeat(some, best.shape[1]))
                of.append(own[best.ravel()])
                far.append(np.take_along_axis(dist, best, 1).ravel())
        out = rows.take(pa.array(np.concatenate(of))).select(names)
        ids = asked["query_id"].take(pa.array(np.concatenate(at)))
        return out.append_column("query_id", ids).append_column("distance", pa.array(np.concatenate(far)))

    schema = T.StructType([*kept, asked.schema["query_id"], T.StructField("distance", T.DoubleType())])
    pairs = left.groupBy("__q", "__r").cogroup(right.groupBy("__q", "__r")).applyInArrow(nearest, schema)
    w = Window.partitionBy("query_id").orderBy(F.round("distance", 9), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def retrieval_stats(hits: DataFrame) -> DataFrame:
    g = hits.groupBy("query_id").agg(
        F.min("distance").alias("min_distance"),
        F.avg("distance").alias("avg_distance"),
        F.count_if(F.col("corpus") == "manuals").alias("manuals"),
        F.count_if(F.col("corpus") == "past_cases").alias("past_cases"),
    )
    return g.withColumn("coverage_ok", (F.col("manuals") > 0) & (F.col("past_cases") > 0))


def merge_hits(parts: list[DataFrame], key: list[str]) -> DataFrame:
    """Stable union: of equal keys the first part's first row stays.  Parts have ``pos``."""
    all_ = None
    for i, p in enumerate(parts):
        p = p.withColumn("src", F.lit(i))
        all_ = p if all_ is None else all_.unionByName(p)
    w = Window.partitionBy(*key).orderBy("src", "pos")
    return all_.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def allowed_only(ids: Column, allowed: Column) -> Column:
    """Ids that are allowed, in order and with repeats."""
    return F.filter(ids, lambda x: F.array_contains(allowed, x))


def top_features(features: Column, n: int = 8) -> Column:
    return F.slice(F.array_sort(F.map_entries(features)), 1, n)


def history_id(df: DataFrame) -> Column:
    key = F.concat_ws(
        "|",
        *[
            F.coalesce(c, F.lit(""))
            for c in (F.col("ahu_id"), F.col("window_id"), F.col("time.start"), F.col("time.end"), F.col("signature"))
        ],
    )
    return F.coalesce(F.nullif(F.trim(F.col("window_id")), F.lit("")), F.sha1(key))


def hypothesis_tokens(c: Column, kind: T.DataType) -> Column:
    """Hypotheses as an array of names: from comma-separated text, a list of texts or maps, or a map's keys.

    A VARIANT column may hold all of these; each value's own type decides (keys in code point order).
    """
    blank = lambda x: x.isNotNull() & (x != "")
    if isinstance(kind, T.VariantType):
        of = lambda v: F.schema_of_variant(v)
        keys = lambda v: F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))
        one = lambda v: F.when(of(v) == "STRING", F.array(F.try_variant_get(v, "$", "string"))).when(
            of(v).startswith("OBJECT"), keys(v)
        )
        nothing = F.array().cast("array<string>")
        items = F.transform(F.try_variant_get(c, "$", "array<variant>"), lambda v: F.coalesce(one(v), nothing))
        found = (
            F.when(of(c) == "STRING", F.split(F.try_variant_get(c, "$", "string"), ","))
            .when(of(c).startswith("ARRAY"), F.flatten(items))
            .when(of(c).startswith("OBJECT"), keys(c))
        )
    elif isinstance(kind, T.StringType):
        found = F.split(c, ",")
    elif isinstance(kind, T.MapType):
        found = F.map_keys(c).cast("array<string>")
    elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.MapType):
        found = F.flatten(F.transform(F.filter(c, lambda m: m.isNotNull()), lambda m: F.map_keys(m)))
    elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
        names = F.array(*[F.lit(f.name) for f in kind.elementType.fields])
        found = F.flatten(F.transform(c, lambda _: names))
    else:
        found = c.cast("array<string>")
    return F.filter(F.transform(F.coalesce(found, F.array().cast("array<string>")), lambda x: F.trim(x)), blank)


def history_documents(summaries: DataFrame) -> DataFrame:
    """(id, text, metadata): window summaries as searchable texts; blanks are left out of the metadata.

    A severity counts only where it is a number.
    """
    kind = summaries.schema["anomalies"].dataType.elementType["fault_hypotheses"].dataType
    hyp = F.flatten(F.transform("anomalies", lambda a: hypothesis_tokens(a["fault_hypotheses"], kind)))
    d = summaries.withColumn("__h", hyp).withColumn("__all", F.array_distinct("__h"))
    times = lambda t: F.size(F.filter(F.col("__h"), lambda x: x == t))
    place = lambda t: F.array_position(F.col("__all"), t)
    first = F.array_sort(
        F.transform("__all", lambda t: F.struct((-times(t)).alias("c"), place(t).alias("p"), t.alias("t")))
    )
    d = d.withColumn("__primary", F.when(F.size("__all") > 0, F.try_element_at(first, F.lit(1))["t"]))
    d = d.withColumn("__f", top_features(F.col("features")))
    four, six = general(4), general(6)
    for i in range(8):
        at = F.try_element_at("__f", F.lit(i + 1))
        shown = F.concat(at["key"], F.lit("="), four(at["value"]))
        d = d.withColumn(f"__f{i}", F.when(F.size("__f") > i, shown))
    number = lambda a: F.nullif(a["severity"].cast("string").try_cast("double"), F.lit(float("nan")))
    d = d.withColumn("__sev", F.array_max(F.transform("anomalies", number)))
    for i in range(5):
        a = F.try_element_at("anomalies", F.lit(i + 1))
        message = compact_text(F.coalesce(F.nullif(a["message"], F.lit("")), a["symptom"]), 80)
        item = F.concat_ws(
            " ",
            F.nullif(F.trim(a["rule_id"]), F.lit("")),
            F.concat(F.lit("sev="), six(number(a))),
            F.when(message != "", F.concat(F.lit("msg="), message)),
        )
        d = d.withColumn(f"__a{i}", F.nullif(F.when(F.size("anomalies") > i, item), F.lit("")))
    has_source = "provenance" in summaries.columns
    source = F.trim(F.coalesce("provenance.config.sha256", F.lit(""))) if has_source else F.lit("")
    blank = F.lit("")
    unit, window, signed = (F.trim(F.coalesce(c, blank)) for c in ("ahu_id", "window_id", "signature"))
    start, end = (F.trim(F.coalesce(f"time.{c}", blank)) for c in ("start", "end"))
    incident = F.when(unit != "", F.concat(unit, F.lit("|"), F.col("__primary")))
    rules = F.filter(F.transform("anomalies", lambda a: F.trim(a["rule_id"])), lambda r: r.isNotNull() & (r != ""))
    # The labels of the lines and the names of the metadata.
    line = lambda name, c: F.when(F.length(c) > 0, F.concat(F.lit(f"{name}: "), c))
    counts = ("sample_count", "missing_count", "late_count", "duplicate_count")
    text = F.concat_ws(
        "\n",
        F.concat(
            F.lit("WINDOW: ahu="), unit, F.lit(" window_id="), window, F.lit(" signature="), signed,
            F.lit(" start="), start, F.lit(" end="), end,
        ),
        line("PRIMARY_HYPOTHESIS", F.col("__primary")),
        line("HYPOTHESES", F.array_join("__all", ", ")),
        line("INCIDENT_KEY", incident),
        line("SUMMARY", compact_text(F.col("text_summary"), 300)),
        F.concat(
            F.lit("ANOMALIES: "),
            F.coalesce(F.nullif(F.concat_ws(" | ", *[F.col(f"__a{i}") for i in range(5)]), blank), F.lit("none")),
        ),
        line("FEATURES", F.concat_ws(", ", *[F.col(f"__f{i}") for i in range(8)])),
        line(
            "STATS", F.concat_ws(", ", *[F.concat(F.lit(f"{c}="), F.col(f"stats.{c}").cast("string")) for c in counts])
        ),
        line("PROVENANCE", F.when(source != "", F.concat(F.lit("sha256="), source))),
        line("MAX_SEVERITY", six("__sev")),
    )
    seconds = lambda c: F.unix_timestamp(to_timestamp(c)).cast("string")
    meta = {
        "ahu_id": unit,
        "window_id": window,
        "signature": signed,
        "start": start,
        "end": end,
        "start_ts": seconds(start),
        "end_ts": seconds(end),
        "fault_hypotheses": F.array_join("__all", ","),
        "primary_fault_hypothesis": F.col("__primary"),
        "incident_key": incident,
        "rule_ids": F.array_join(rules, ","),
        "max_severity": six("__sev"),
        **{c: F.col(f"stats.{c}").cast("string") for c in counts},
        "feature_keys": F.array_join(F.transform("__f", lambda f: f["key"]), ","),
        "provenance_sha256": source,
        "source": F.lit("window_history"),
    }
    pairs = F.create_map(*[x for k, v in meta.items() for x in (F.lit(k), v)])
    metadata = F.map_filter(pairs, lambda _, v: v.isNotNull() & (v != ""))
    return d.select(history_id(d).alias("id"), text.alias("text"), metadata.alias("metadata"))


def case_documents(cases: DataFrame) -> DataFrame:
    """(id, text, metadata): past cases as searchable texts; lists are joined by ``|``, missing fields are empty."""

    def show(c: Column) -> Column:
        return F.coalesce(c.cast("string"), F.lit(""))

    def listed(name: str) -> Column:
        if name not in cases.columns:
            return F.lit("")
        is_list = isinstance(cases.schema[name].dataType, T.ArrayType)
        return F.coalesce(F.array_join(F.col(name), "|"), F.lit("")) if is_list else show(F.col(name))

    def own(name: str) -> Column:
        return show(F.col(name)) if name in cases.columns else F.lit("")

    has_pattern = "window_pattern" in cases.columns
    inner = set(cases.schema["window_pattern"].dataType.names) if has_pattern else set()
    pattern = lambda n: show(F.col(f"window_pattern.{n}")) if n in inner else F.lit("")
    # The labels of the lines and the names of the metadata.
    parts = [
        ("CASE_ID: ", own("case_id")),
        ("\nFAULT: ", own("fault_type")),
        ("\nTITLE: ", own("fault_title")),
        ("\nSYMPTOMS: ", listed("symptoms")),
        ("\nWINDOW_PATTERN: persistence=", pattern("persistence_windows")),
        (", severity=", pattern("severity")),
        (", notes=", pattern("trend_notes")),
        ("\nROOT_CAUSE: ", own("likely_root_cause")),
        ("\nVERIFICATION: ", listed("verification_steps")),
        ("\nRESOLUTION: ", listed("resolution_steps")),
        ("\nEXPECTED_POST_FIX: ", listed("expected_post_fix_behavior")),
        ("\nTAGS: ", listed("tags")),
    ]
    text = F.regexp_replace(F.concat(*[x for name, v in parts for x in (F.lit(name), v)]), r"^\s+|\s+$", "")
    there = lambda n: F.col(n).cast("string") if n in cases.columns else F.lit(None).cast("string")
    meta = {n: there(n) for n in ("case_id", "fault_type", "equipment_scope")}
    meta |= {"tags": listed("tags"), "confidence": there("confidence"), "source": F.lit("past_case")}
    metadata = F.create_map(*[x for k, v in meta.items() for x in (F.lit(k), v)])
    return cases.select(F.col("case_id").cast("string").alias("id"), text.alias("text"), metadata.alias("metadata"))


def upsert_documents(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Last write wins."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)
