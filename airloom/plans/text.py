"""Retrieval and manual queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import manuals, retrieval
from ..sources.adapter import page_table, read

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _queries(spark, sf) -> DataFrame:
    """Every vector whose id is divisible by 20 asks."""
    return read(spark, sf, "embeddings").where("vec_id % 20 = 0").select(
        F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_embedding")
    )


def _knn(where: str, k: int) -> str:
    return f"""e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
p AS (SELECT q.vec_id AS query_id, e.vec_id, e.label, 1 - list_dot_product(q.v, e.v) / sqrt(list_dot_product(q.v,
  q.v)) / sqrt(list_dot_product(e.v, e.v)) AS distance FROM e JOIN e q ON q.vec_id % 20 = 0 WHERE {where}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), vec_id) AS rank
  FROM p), h AS (SELECT * FROM r WHERE rank <= {k})"""


@query(
    f"WITH {_knn('true', 5)} SELECT query_id, vec_id, rank::INT AS rank, round(distance, 6) AS distance, "
    f"round(1 / (1 + distance), 6) AS similarity FROM h WHERE rank > 1"
)
def q44_knn(spark, sf) -> DataFrame:
    h = retrieval.knn(read(spark, sf, "embeddings"), _queries(spark, sf), 5).where("rank > 1")
    return h.select(
        "query_id",
        "vec_id",
        "rank",
        F.round("distance", 6).alias("distance"),
        F.round(S.similarity(F.col("distance")), 6).alias("similarity"),
    )


@query(f"WITH {_knn('e.label = 3', 4)} SELECT query_id, vec_id, rank::INT AS rank FROM h")
def q45_knn_where(spark, sf) -> DataFrame:
    return retrieval.knn(
        read(spark, sf, "embeddings"), _queries(spark, sf), 4, F.col("label") == 3
    ).select("query_id", "vec_id", "rank")


@query(
    f"WITH {_knn('true', 8)} SELECT query_id, round(min(distance), 6) AS min_distance, round(avg(distance), "
    f"6) AS avg_distance, count(*) FILTER (WHERE label < 5) AS manuals, "
    f"count(*) FILTER (WHERE label >= 5) AS past_cases, count(*) FILTER (WHERE label < 5) > 0 "
    f"AND count(*) FILTER (WHERE label >= 5) > 0 AS coverage_ok FROM h GROUP BY 1"
)
def q46_retrieval_stats(spark, sf) -> DataFrame:
    h = retrieval.knn(read(spark, sf, "embeddings"), _queries(spark, sf), 8).withColumn(
        "corpus", F.when(F.col("label") < 5, "manuals").otherwise("past_cases")
    )
    return retrieval.retrieval_stats(h).withColumns({c: F.round(c, 6) for c in ("min_distance", "avg_distance")})


@query(
    "WITH a AS (SELECT vec_id, label, 0 AS src, vec_id AS pos FROM embeddings WHERE vec_id % 3 = 0 "
    "UNION ALL SELECT vec_id, label, 1, 100000 - vec_id FROM embeddings) SELECT vec_id, label, src, pos "
    "FROM (SELECT *, row_number() OVER (PARTITION BY vec_id, label ORDER BY src, pos) AS n FROM a) WHERE n = 1"
)
def q47_merge_docs(spark, sf) -> DataFrame:
    e = read(spark, sf, "embeddings").select("vec_id", "label")
    return retrieval.merge_hits(
        [e.where("vec_id % 3 = 0").withColumn("pos", F.col("vec_id")), e.withColumn("pos", 100000 - F.col("vec_id"))],
        ["vec_id", "label"],
    )


_PAGES = "pg AS (SELECT source AS doc_id, doc_id AS page_no, text FROM documents)"
_LINES = f"{_PAGES}, ln AS (SELECT doc_id, page_no, unnest(range(len(s))) AS line_no, trim(unnest(s)) AS line FROM (SELECT doc_id, page_no, string_split_regex(text, '\\r\\n|\\n|\\r') AS s FROM pg))"


@query(
    f"WITH {_LINES}, np AS (SELECT doc_id, count(DISTINCT page_no) AS n FROM pg "
    f"GROUP BY 1) SELECT doc_id, line, count(DISTINCT page_no) AS pages FROM ln JOIN np USING (doc_id) "
    f"WHERE line <> '' AND length(line) <= 80 GROUP BY doc_id, line, n "
    f"HAVING count(DISTINCT page_no) / n >= 0.01"
)
def q48_repeated_lines(spark, sf) -> DataFrame:
    return manuals.repeated_lines(page_table(spark, sf), 0.01)  # invented pages share few lines


_words = "list_filter(string_split_regex(s, '\\s+'), lambda w: w <> '')"
_HEAD = f"""length(s) > 0 AND length(s) <= 120 AND (regexp_matches(s,
  '^\\d+(\\.\\d+){{0,4}}[\\).:-]?\\s+\\S+') OR regexp_matches(lower(s), '^(section|chapter|appendix)\\s+\\w+')
  OR (len(regexp_extract_all(s, '\\p{{L}}')) > 0 AND len(regexp_extract_all(s,
  '\\p{{Lu}}')) / greatest(len(regexp_extract_all(s, '\\p{{L}}')), 1) >= 0.7 AND len({_words}) <= 12)
  OR (len({_words}) <= 10 AND regexp_matches(s, '^[A-Za-z0-9 ,:/()\\-]+$') AND len(list_filter({_words},
  lambda w: regexp_matches(w, '^\\p{{Lu}}'))) / greatest(len({_words}), 1) >= 0.7))"""
_SECT = f"""{_PAGES}, dl AS (SELECT doc_id, unnest(range(len(x))) AS line_no, trim(unnest(x)) AS s
  FROM (SELECT doc_id, string_split_regex(text, '\\r\\n|\\n|\\r') AS x FROM documents)),
hd AS (SELECT *, {_HEAD} AS h FROM dl WHERE s <> ''), sc AS (SELECT *,
  sum(h::INT) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section
  FROM hd)"""


@query(
    f"WITH {_SECT} SELECT doc_id, section::BIGINT AS section, coalesce(max(s) FILTER (WHERE h), '') AS heading, "
    f"string_agg(s, chr(10) ORDER BY line_no) FILTER (WHERE NOT h) AS body FROM sc GROUP BY 1, 2 "
    f"HAVING count(*) FILTER (WHERE NOT h) > 0"
)
def q49_headings_sections(spark, sf) -> DataFrame:
    return manuals.text_sections(read(spark, sf, "documents").select("doc_id", "text"))


_size, _stride = manuals.words_for(300), manuals.words_for(300) - manuals.words_for(110)


@query(
    f"WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS w "
    f"FROM documents), n AS (SELECT *, unnest(generate_series(0, greatest(0, "
    f"ceil((len(w) - {_size}) / {_stride})::INT))) AS chunk_no FROM w "
    f"WHERE len(w) > 0) SELECT doc_id, chunk_no::INT AS chunk_no, "
    f"md5(array_to_string(w[chunk_no * {_stride} + 1 : chunk_no * {_stride} + {_size}], ' ')) AS chunk FROM n"
)
def q50_word_chunks(spark, sf) -> DataFrame:
    c = manuals.word_chunks(read(spark, sf, "documents").select("doc_id", "text"), "text", 300, 110)
    return c.select("doc_id", "chunk_no", F.md5("chunk").alias("chunk"))


_H, _T = "lower(coalesce(source, '') || CASE doc_id % 9 WHEN 0 THEN ' Table of Contents' WHEN 1 THEN ' Fault Table' WHEN 2 THEN ' Startup steps' WHEN 3 THEN ' Checklist' WHEN 4 THEN ' Glossary' WHEN 5 THEN ' Formula' WHEN 6 THEN ' Case' WHEN 7 THEN ' fault' ELSE '' END)", "lower(coalesce(text, '') || CASE doc_id % 4 WHEN 0 THEN ' procedure step' WHEN 1 THEN ' table' ELSE '' END)"


@query(f"""WITH d AS (SELECT doc_id, {_H} AS h, {_T} AS t FROM documents) SELECT doc_id, CASE
  WHEN contains(h, 'table of contents') OR trim(h) = 'contents' OR (contains(h,
  'contents') AND len(list_filter(string_split_regex(h, '\\s+'), lambda w: w <> '')) <= 3) THEN 'toc'
  WHEN contains(h, 'fault') AND (contains(h, 'table') OR contains(t, 'table')) THEN 'fault_table'
  WHEN contains(h, 'procedure') OR contains(h, 'steps') OR contains(h, 'startup') OR contains(h,
  'shutdown') THEN 'procedure'
  WHEN contains(h, 'checklist') OR contains(h, 'check list') THEN 'checklist'
  WHEN contains(h, 'definition') OR contains(h, 'glossary') THEN 'definition'
  WHEN contains(h, 'equation') OR contains(h, 'formula') THEN 'equation'
  WHEN contains(h, 'example') OR contains(h, 'case') THEN 'case_example'
  WHEN regexp_matches(t, '\\bprocedure\\b') AND regexp_matches(t, '\\bstep\\b') THEN 'procedure'
  ELSE 'general_section' END AS chunk_type FROM d""")
def q51_chunk_type(spark, sf) -> DataFrame:
    d = read(spark, sf, "documents")
    h = F.expr(
        "concat(coalesce(source, ''), CASE doc_id % 9 WHEN 0 THEN ' Table of Contents' "
        "WHEN 1 THEN ' Fault Table' WHEN 2 THEN ' Startup steps' WHEN 3 THEN ' Checklist' "
        "WHEN 4 THEN ' Glossary' WHEN 5 THEN ' Formula' WHEN 6 THEN ' Case' WHEN 7 THEN ' fault' ELSE '' END)"
    )
    t = F.expr(
        "concat(coalesce(text, ''), CASE doc_id % 4 WHEN 0 THEN ' procedure step' WHEN 1 THEN ' table' ELSE '' END)"
    )
    return d.select("doc_id", manuals.chunk_type(h, t).alias("chunk_type"))


_SPANS = f"""{_PAGES}, sp AS (SELECT doc_id, page_no, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t
  FROM pg), ps AS (SELECT doc_id, page_no, coalesce(sum(length(t) + 1) OVER (PARTITION BY doc_id
  ORDER BY page_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS a, length(t) AS n FROM sp),
pc AS (SELECT doc_id, unnest(range(0, ceil(max(a + n) / 2500.0)::BIGINT)) AS piece FROM ps
  GROUP BY doc_id), pp AS (SELECT doc_id, piece, piece * 2500 AS s, piece * 2500 + 3000 AS e FROM pc)"""


@query(
    f"WITH {_SPANS} SELECT pp.doc_id, piece::INT AS piece, min(page_no) AS first_page, max(page_no) AS last_page "
    f"FROM pp JOIN ps ON pp.doc_id = ps.doc_id AND a + n > s AND a < e GROUP BY 1, 2"
)
def q52_chunk_pages(spark, sf) -> DataFrame:
    spans = manuals.page_spans(page_table(spark, sf))
    n = F.ceil(F.max("page_end") / 2500).cast("int")
    pieces = spans.groupBy("doc_id").agg(n.alias("n")).where("n > 0").select(
        "doc_id", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("piece")
    )
    pieces = pieces.selectExpr(
        "doc_id", "piece", "CAST(piece AS BIGINT) * 2500 AS start", "CAST(piece AS BIGINT) * 2500 + 3000 AS end"
    )
    return manuals.page_range(spans, pieces)


@query(
    "SELECT page_id, md5(trim(regexp_replace(regexp_replace(replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), "
    "chr(160), ' '), '[ \\t]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), "
    "' ' || chr(10) || chr(13) || chr(9) || chr(11) || chr(12))) AS text FROM pages"
)
def q54_html_text_norm(spark, sf) -> DataFrame:
    p = read(spark, sf, "pages")
    return p.select("page_id", F.md5(manuals.normal_space(F.regexp_replace("html", "<[^>]*>", " "))).alias("text"))


@query("SELECT event_id, 'u' || user_id::VARCHAR AS unit, event_type AS kind FROM events")
def q55_kv_line_parse(spark, sf) -> DataFrame:
    from ..sources.readers import kv_line

    lines = read(spark, sf, "events").select(
        "event_id", F.expr("concat('unit=u', user_id, ' | kind=', event_type, ' | note')").alias("line")
    )
    return lines.withColumn("kv", kv_line(F.col("line"))).select(
        "event_id", F.col("kv")["unit"].alias("unit"), F.col("kv")["kind"].alias("kind")
    )


@query("SELECT doc_id, floor(len(regexp_extract_all(text, '\\S+')) * 1.3::DOUBLE)::INT AS tokens FROM documents")
def q58_token_estimate(spark, sf) -> DataFrame:
    return read(spark, sf, "documents").select("doc_id", S.token_estimate(F.col("text")).alias("tokens"))
