"""Readers for files and streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Config
from ..operators.normalize import normalize_events

# Fields of a window summary.
SUMMARY_SCHEMA = (
    "window_id string, ahu_id string, time struct<start:string,end:string,window_type:string,window_size_sec:int,step_sec:int>, stats struct<sample_count:bigint,missing_count:bigint,duplicate_count:bigint,late_count:bigint>, "
    "features map<string,double>, anomalies array<struct<rule_id:string,severity:string,message:string,symptom:string,fault_hypotheses:array<string>,evidence:string>>, signature string, text_summary string"
)


def csv_events(
    spark: SparkSession, path: str, required: tuple[str, ...] = ("timestamp",), typed: Config | None = None
) -> DataFrame:
    """Telemetry CSV with a header, all columns as text; ``typed`` gives times, units and signals of a vocabulary."""
    df = spark.read.option("header", True).csv(path)
    if missing := sorted(set(required) - set(df.columns)):
        raise ValueError(f"{path}: missing columns {missing}")
    return normalize_events(df, typed) if typed else df


def inspect_parquet(spark: SparkSession, path: str) -> DataFrame:
    """(position, column, type, nullable, rows, nulls) of a parquet table, by one scan."""
    df = spark.read.parquet(path)
    nulls = F.array(*[F.count_if(F.col(f"`{c}`").isNull()) for c in df.columns])
    counts = df.agg(F.count("*").alias("rows"), nulls.alias("nulls"))
    fields = F.array(
        *[
            F.struct(
                F.lit(i).alias("position"),
                F.lit(f.name).alias("column"),
                F.lit(f.dataType.simpleString()).alias("type"),
                F.lit(f.nullable).alias("nullable"),
            )
            for i, f in enumerate(df.schema.fields)
        ]
    )
    rows = counts.select("rows", F.explode(F.arrays_zip(fields.alias("f"), F.col("nulls"))).alias("x"))
    return rows.select("x.f.*", "rows", F.col("x.nulls").alias("nulls"))


def jsonl_summaries(spark: SparkSession, path: str, strict: bool = False, most: int | None = None) -> DataFrame:
    """Window summaries, one JSON object a line; bad lines are dropped, or an error with ``strict``."""
    df = spark.read.schema(SUMMARY_SCHEMA).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)
    return df.limit(most) if most else df


def json_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Lines of new files in a folder as a streaming ``value`` column; the file twin of ``kafka_stream``."""
    r = spark.readStream.format("text")
    return (r.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else r).load(path)


def kafka_stream(
    spark: SparkSession,
    servers: str,
    topic: str,
    from_beginning: bool = False,
    most_per_trigger: int | None = None,
    group: str | None = None,
) -> DataFrame:
    """A topic's values; needs Spark's Kafka package on the class path.

    ``group`` begins the names of consumer groups, such as ``config.Settings.consumer_group`` gives it: each query
    has one of its own.  Positions are kept in the query's checkpoint folder, so a new folder replays.
    """
    r = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
    r = r.option("startingOffsets", "earliest" if from_beginning else "latest")
    r = r.option("groupIdPrefix", group) if group else r
    return (r.option("maxOffsetsPerTrigger", most_per_trigger) if most_per_trigger else r).load()


def documents_metadata(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def past_cases(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path).where("case_id IS NOT NULL AND trim(case_id) <> ''")


def manifest(spark: SparkSession, path: str, lists: tuple[str, ...] = ()) -> DataFrame:
    """A manifest CSV; columns in ``lists`` hold values joined by ``|``."""
    df = spark.read.option("header", True).option("multiLine", True).csv(path)
    return df.withColumns({c: F.split(c, r"\|") for c in lists if c in df.columns})


def pdf_pages(spark: SparkSession, path: str) -> DataFrame:
    """(path, page_no, text) of PDF files; needs the pypdf package."""
    import pandas as pd

    def run(batches):
        import io

        from pypdf import PdfReader

        for pdf in batches:
            rows = [
                (p, i + 1, page.extract_text() or "")
                for p, c in zip(pdf.path, pdf.content)
                for i, page in enumerate(PdfReader(io.BytesIO(c)).pages)
            ]
            yield pd.DataFrame(rows, columns=["path", "page_no", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(
        run, "path string, page_no int, text string"
    )


def kv_line(line: Column) -> Column:
    """``k=v | k=v`` as a map; parts without ``=`` are left out."""
    parts = F.filter(F.split(line, r"\s*\|\s*"), lambda p: p.contains("="))
    return F.map_from_entries(
        F.transform(
            parts,
            lambda p: F.struct(
                F.trim(F.substring_index(p, "=", 1)).alias("key"),
                F.trim(F.regexp_replace(p, r"^[^=]*=", "")).alias("value"),
            ),
        )
    )


def ordered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, n, line) of text files; block and n put a file's lines in order, however it was split."""
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("n"),
        F.col("value").alias("line"),
    )


def last_summaries(spark: SparkSession, path: str, most: int, unit: str | None = None) -> DataFrame:
    """The last ``most`` summaries of each unit (or of one) by their lines' order; other lines are skipped."""
    d = ordered_lines(spark, path).withColumn("w", F.from_json("line", SUMMARY_SCHEMA))
    ok = F.trim("line").startswith("{") & F.try_parse_json("line").isNotNull()
    d = d.where(ok & F.col("w").isNotNull())
    if unit is not None:
        d = d.where(F.col("w.ahu_id") == unit)
    latest = Window.partitionBy("w.ahu_id").orderBy(F.desc("file"), F.desc("block"), F.desc("n"))
    return d.withColumn("__n", F.row_number().over(latest)).where(F.col("__n") <= most).select("w.*")


# Marks of a retrieval log's lines and the corpora that its headings name.
LOG_CORPORA = {"Manuals": "manuals", "Past Cases": "past_cases"}
LOG_SNIPPET, LOG_END = "snippet:", "✅"
LOG_MOST = 3


def retrieval_log(spark: SparkSession, path: str, most: int = LOG_MOST) -> DataFrame:
    """(file, query, fault_type, corpus, rank, doc_id, distance, metadata, text): documents that retrieval logs show.

    A section ``Qn:`` ends at the next line that starts with Q; under a corpus' heading an entry ``#k id=`` has a
    distance, ``key=value | ...`` lines that begin with doc_id or case_id, and a snippet up to an empty line.
    Of a corpus the first ``most`` entries count, of a file the first section of a number.  Lines become rows; windows
    over a section find what each belongs to.
    """
    d = ordered_lines(spark, path).withColumn("s", F.trim(F.regexp_replace("line", r"^\s+|\s+$", "")))
    in_file = Window.partitionBy("file").orderBy("block", "n").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("section", F.count_if(F.col("s").startswith("Q")).over(in_file)).where("section > 0")
    order = Window.partitionBy("file", "section").orderBy("block", "n")
    so_far, earlier = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    entry = F.col("s").startswith("#") & F.col("s").contains("id=")
    stop = (F.col("s") == "") | entry | F.col("s").startswith(LOG_END)
    mark = F.when(stop, 0).when(F.col("s") == LOG_SNIPPET, 1)
    d = d.withColumn("entry", entry).withColumn("mark", mark).withColumn("stop", stop)
    inside = F.coalesce(F.last("mark", ignorenulls=True).over(earlier), F.lit(0)) == 1
    d = d.withColumn("inside", inside & ~F.col("stop"))
    named = F.coalesce(*[F.when(F.col("s").startswith(k), F.lit(v)) for k, v in LOG_CORPORA.items()])
    d = d.withColumn("named", F.when(~F.col("inside"), named))
    d = d.withColumn("corpus", F.last("named", ignorenulls=True).over(so_far))
    d = d.withColumn("item", F.count_if(F.col("entry") | F.col("named").isNotNull()).over(so_far))
    first = F.first("s").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    d = d.withColumn("query", F.regexp_extract(first, r"^Q(\d+):", 1).try_cast("int"))
    fault = F.trim(F.regexp_replace(first, r"^.*?fault_type=", ""))
    d = d.withColumn("fault_type", F.when(first.contains("fault_type="), fault))
    after = lambda mark: F.regexp_replace("s", rf"^.*?{mark}=", "")
    far = F.regexp_extract(after("distance"), r"^\s*(\S+)", 1).try_cast("double")
    told = ~F.col("inside") & F.col("s").contains("distance=")
    facts = ~F.col("inside") & F.col("s").rlike("^(doc_id|case_id)=")
    shown = F.col("inside") & (F.col("s") != "")
    place = F.struct("block", "n")
    pairs = F.struct(place.alias("p"), F.map_entries(kv_line(F.col("s"))).alias("kv"))
    of_number = Window.partitionBy("file", "query")
    d = d.where("query IS NOT NULL").withColumn("whole", F.col("section") == F.min("section").over(of_number))
    items = d.where("whole AND corpus IS NOT NULL").groupBy("file", "section", "query", "item").agg(
        F.max("fault_type").alias("fault_type"),
        F.min("corpus").alias("corpus"),
        F.max(F.when(F.col("entry"), F.trim(after("id")))).alias("doc_id"),
        F.max_by(F.when(told, F.struct(far.alias("v"))), F.when(told, place))["v"].alias("distance"),
        F.array_sort(F.collect_list(F.when(facts, pairs))).alias("facts"),
        F.array_sort(F.collect_list(F.when(shown, F.struct(place.alias("p"), "s")))).alias("lines"),
    ).where("doc_id <> ''")
    kept = Window.partitionBy("file", "section", "corpus").orderBy("item")
    items = items.withColumn("rank", F.row_number().over(kept)).where(F.col("rank") <= most)
    pairs = F.flatten("facts.kv")
    names = F.array_distinct(F.transform(pairs, lambda e: e["key"]))
    value = lambda k: F.try_element_at(F.filter(pairs, lambda e: e["key"] == k), F.lit(-1))["value"]
    return items.select(
        *"file query fault_type corpus rank doc_id distance".split(),
        F.map_from_arrays(names, F.transform(names, value)).alias("metadata"),
        F.array_join("lines.s", " ").alias("text"),
    )


def telemetry_schema(signals) -> T.StructType:
    return T.StructType(
        [
            T.StructField("timestamp", T.StringType()),
            T.StructField("ahu_id", T.StringType()),
            *[T.StructField(s, T.StringType()) for s in signals],
        ]
    )
