"""Scalar expressions: coercion, times, ids, formats."""

from __future__ import annotations

import json
from decimal import ROUND_HALF_EVEN, Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

ISO = r"^\d{4}-\d{2}-\d{2}([ T]\d{2}(:\d{2}(:\d{2}(\.\d+)?)?)?(Z|[+-]\d{2}:?\d{2})?)?$"


def to_float(c: Column) -> Column:
    """Double from text, number or boolean; blank, nan, null, none and anything else that isn't a number is null."""
    s = F.trim(c.cast("string"))
    number = F.when(
        F.lower(s).isin("true", "false"), (F.lower(s) == "true").cast("double")
    ).otherwise(s.try_cast("double"))
    return F.nullif(
        F.when(F.lower(s).isin("", "nan", "null", "none"), F.lit(None)).otherwise(number), F.lit(float("nan"))
    )


def to_timestamp(c: Column) -> Column:
    """UTC timestamp from ISO-8601 text; naive times are UTC, other text is null."""
    s = F.trim(c)
    return F.when(s.rlike(ISO), s.try_cast("timestamp"))


def iso_z(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def epoch_floor(ts: Column, seconds: int) -> Column:
    e = F.unix_timestamp(ts)
    return F.timestamp_seconds(e - F.pmod(e, F.lit(seconds)))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def rounded(x: Column, digits: int) -> Column:
    """Rounded, keeping the sign of a negative that rounds to zero, as a double does."""
    r = F.round(x, digits)
    return F.when((r == 0) & (x < 0), -F.abs(r)).otherwise(r)


def severity_rank(c: Column) -> Column:
    s = F.lower(F.trim(c))
    return F.when(s == "high", 3).when(s == "medium", 2).when(s == "low", 1).otherwise(0)


def event_id(unit: Column, timestamp_text: Column) -> Column:
    """SHA-256 over the canonical JSON of unit and raw timestamp text."""
    quote = lambda c: F.to_json(F.array(c))
    inner = lambda c: F.regexp_replace(quote(c), r"^\[|\]$", "")
    return F.sha2(
        F.concat(F.lit('{"ahu_id":'), inner(unit), F.lit(',"timestamp":'), inner(timestamp_text), F.lit("}")), 256
    )


def signature(rule_ids: Column) -> Column:
    """SHA-256 over the sorted distinct rule ids; windows without any share the hash of the empty text."""
    return F.sha2(F.array_join(F.array_sort(F.array_distinct(rule_ids)), "|"), 256)


def window_id(unit: Column, start: Column, end: Column, kind: Column) -> Column:
    return F.concat_ws("_", unit, iso_z(start), iso_z(end), kind)


def compact_text(c: Column, limit: int) -> Column:
    s = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), "\n", " "))
    return F.when(F.length(s) > limit, F.concat(F.substring(s, 1, max(0, limit - 3)), F.lit("..."))).otherwise(s)


def fraction(c: Column) -> Column:
    """A share from a share or a percentage, within 0 and 1."""
    return clamp(F.when(c > 1, c / 100).otherwise(c), 0.0, 1.0)


def fixed(digits: int):
    """Fixed decimals of the exact binary value, ties to even; null is ``n/a``.  An Arrow UDF, for aggregated rows."""

    @F.pandas_udf(StringType())
    def fmt(x: pd.Series) -> pd.Series:
        return x.map(
            lambda v: "n/a" if v is None or pd.isna(v) else str(
                Decimal(float(v)).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_EVEN)
            )
        ).astype(object)

    return fmt


def general(digits: int):
    """So many significant digits without trailing zeros."""

    @F.pandas_udf(StringType())
    def fmt(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None or pd.isna(v) else f"{float(v):.{digits}g}").astype(object)

    return fmt


def token_estimate(text: Column) -> Column:
    """1.3 tokens a word, rounded down."""
    return F.floor(F.regexp_count(text, F.lit(r"\S+")) * F.lit(1.3)).cast("int")


def similarity(distance: Column) -> Column:
    return 1 / (1 + distance)


def parsed_object(text: str | None) -> dict | None:
    """The JSON object that a text is, or else the one that its first brace opens; None if that isn't valid."""
    text = (text or "").strip()
    if not text:
        return None
    try:
        found = json.loads(text)
    except ValueError:
        try:
            found, _ = json.JSONDecoder().raw_decode(text, text.index("{"))
        except ValueError:
            return None
    return found if isinstance(found, dict) else None


@F.pandas_udf(StringType())
def first_json_object(x: pd.Series) -> pd.Series:
    """``parsed_object`` of each text as JSON with its keys in their order; null if there is none."""
    show = lambda d: None if d is None else json.dumps(d, ensure_ascii=False)
    return x.map(lambda t: show(parsed_object(t)) if isinstance(t, str) else None).astype(object)


def ticket_ref(ticket_id: Column, digits: int | Column = 4) -> Column:
    """``TCK-`` and the first hex digits of the id's hash; ``operators.tickets.references`` widens those that meet."""
    return F.concat(F.lit("TCK-"), F.upper(F.substring(F.sha1(ticket_id), F.lit(1), F.lit(digits))))


def is_window_evidence(c: Column) -> Column:
    return c.contains("_300s_tumbling") | F.lower(c).startswith("window:")


def is_chunk_evidence(c: Column) -> Column:
    return c.contains("::chunk::")


def is_case_evidence(c: Column) -> Column:
    return c.contains("CASE")


def evidence_kind(c: Column) -> Column:
    """window, chunk, case or other; an id that fits several tests has the first of them."""
    kind = F.when(is_window_evidence(c), "window").when(is_chunk_evidence(c), "chunk")
    return kind.when(is_case_evidence(c), "case").otherwise("other")


def evidence_lists(ids: Column) -> Column:
    """Struct of the distinct ids of each kind, in order; an id that fits several tests is in each of their lists."""
    own = F.array_distinct(F.filter(ids, lambda x: x.isNotNull() & (x != "")))
    other = lambda x: ~is_window_evidence(x) & ~is_chunk_evidence(x) & ~is_case_evidence(x)
    tests = {"windows": is_window_evidence, "chunks": is_chunk_evidence, "cases": is_case_evidence, "other": other}
    return F.struct(*[F.filter(own, test).alias(name) for name, test in tests.items()])


def json_list(c: Column) -> Column:
    """A list from JSON text, elements as texts; null, blank, other JSON and no JSON at all give the empty list."""
    return F.coalesce(
        F.from_json(F.when(F.trim(c).startswith("["), c), "array<string>"), F.array().cast("array<string>")
    )


def json_value(c: Column) -> Column:
    """A JSON text's value in compact form, other text as a JSON string; null where there is none."""
    own = F.nullif(F.trim(c), F.lit(""))
    text = F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")
    return F.when(own.isNotNull(), F.coalesce(F.to_json(F.try_parse_json(own)), text))
