"""URL filters: pattern rules found through their rarest literal token."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

TOKEN = r"[a-z0-9]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """A regular expression for host + path, and tokens every URL that fits must have.

    ``name`` is the rule string of a host and path rule, None for a pattern of the method itself.  With
    ``whole`` the expression is for the whole URL.  A rule without literals is tried on every URL.
    """

    pattern: str
    literals: tuple[str, ...]
    verdict: str
    name: str | None = None
    whole: bool = False


def host_path_rule(verdict: str, rule: str) -> Rule:
    """A host with all its subdomains and a path prefix, such as ``example.org/es/``."""
    host, slash, path = rule.partition("/")
    path = slash + path
    tokens = re.findall(TOKEN, host.lower())
    inside = path if re.search(r"[^A-Za-z0-9]$", path) else re.sub(r"[A-Za-z0-9]*$", "", path)
    return Rule(
        rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}",
        tuple(tokens + re.findall(TOKEN, inside.lower())),
        verdict,
        rule,
    )


def parse_rules(lines: Iterable[str]) -> tuple[Rule, ...]:
    """Rules from lines of the usual filter syntax; comments (``!``) and empty lines are left out.

    ``||host^`` is a host with its subdomains, ``|`` an end of the URL, ``*`` anything, ``^`` a separator or the
    end, ``/.../`` a regular expression, ``@@`` before a rule an exception, which allows.  Case doesn't count.
    A rule that starts with ``||`` or names no scheme is for host and path, others are for the whole URL.
    """
    out = []
    for line in lines:
        text = line.strip()
        if not text or text.startswith("!"):
            continue
        verdict = "allow" if text.startswith("@@") else "block"
        text = text.removeprefix("@@")
        if len(text) > 2 and text[0] == text[-1] == "/" and re.search(r"[\[\](){}+?\\]", text):
            out.append(Rule(f"(?i){text[1:-1]}", (), verdict))
            continue
        whole = text.startswith("|") and not text.startswith("||") or "://" in text or text.endswith("|")
        host, text = text.startswith("||"), text.removeprefix("||")
        start, end = text.startswith("|"), text.endswith("|")
        body = text[1 if start else 0 : -1 if end else None]
        marks = {"*": ".*", "^": r"(?:[^A-Za-z0-9_.%-]|\Z)"}
        pattern = "".join(marks.get(c) or re.escape(c) for c in body)
        before = r"^(?:[^/]*\.)?" if host and not whole else "^" if start else ""
        # a token counts if the pattern says what stands on both its sides
        tokens = [
            m[0].lower()
            for m in re.finditer(r"[A-Za-z0-9]+", body)
            if (m.start() > 0 and body[m.start() - 1] != "*" or m.start() == 0 and (host or start))
            and (m.end() < len(body) and body[m.end()] != "*" or m.end() == len(body) and end)
        ]
        out.append(Rule(f"(?i){before}{pattern}{chr(92) + 'Z' if end else ''}", tuple(tokens), verdict, None, whole))
    return tuple(out)


HOST_RULES = tuple(
    host_path_rule(*r)
    for r in (
        ("allow", "org/"),
        ("block", "example.org/es/"),
        ("block", "example.org/en/1"),
        ("allow", "com/fr/"),
        ("block", "com/de/"),
    )
)
#: Host names of spam, gambling, adult and tracking sites, and paths without content of their own.
HOST_TERMS = (
    "ads",
    "adult",
    "adserver",
    "bets",
    "casino",
    "clickbait",
    "pills",
    "poker",
    "porn",
    "spam",
    "tracker",
    "viagra",
    "warez",
    "xxx",
)
PATH_TERMS = ("cart", "checkout", "login", "signin", "signup")
METHOD_RULES = tuple(Rule(rf"^(?:[^/]*[.\-])?{t}[.\-]", (t,), "block") for t in HOST_TERMS) + tuple(
    Rule(rf"^[^/]*/(?:.*/)?{t}(?:[/.]|\Z)", (t,), "block") for t in PATH_TERMS
)


def host(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, UPPER, LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rarest_index(rules: tuple[Rule, ...], counts: dict[str, int]) -> dict[str, list[int]]:
    """Rules by the literal token that the fewest URLs have (ties: the first in order); those without under the empty one."""
    index: dict[str, list[int]] = {}
    for i, r in enumerate(rules):
        index.setdefault(min(r.literals, key=lambda t: (counts.get(t, 0), t), default=""), []).append(i)
    return index


def judge(pages: DataFrame, rules: tuple[Rule, ...] = HOST_RULES + METHOD_RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, candidates) for every row of ``pages`` (page_id, url).

    How many URLs have each rule token is counted over all rows; a rule is indexed under its rarest
    one, so a URL runs the regular expressions only of rules that its own tokens fetch, and of rules without
    literals (candidates: how many).  Of the host and path rules that fit, the longest decides (ties: by code
    point); without one no rule is named, and a fitting exception allows, else any fitting pattern blocks,
    else the URL is allowed.  A null URL or one without ``://`` has an empty host and path and is allowed.  Rows
    are judged one by one, so repeated rows get equal results and hot hosts cost nothing more; other columns
    are ignored; no rows give no rows.  ``rules`` go to every task; they are a parameter, not data.
    """
    plain = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url")
    )
    plain = plain.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), "url")
    some_whole = any(r.whole for r in rules)
    text = F.col("url") if some_whole else F.concat("host", "path")
    literals = sorted({t for r in rules for t in r.literals})
    own = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), 0))
    known = F.array(*map(F.lit, literals)) if literals else F.array().cast("array<string>")
    seen = plain.select(F.explode(F.array_intersect(own, known)).alias("token")).groupBy("token").count()
    index = rarest_index(rules, {r["token"]: r["count"] for r in seen.collect()})  # a row per rule token at most
    compiled = [re.compile(r.pattern, re.S) for r in rules]
    token = re.compile(TOKEN)

    def run(batches):
        for batch in batches:
            names, verdicts, tried = [], [], []
            for h, p, url in zip(*(batch.column(c).to_pylist() for c in ("host", "path", "url"))):
                short = h + p
                tokens = set(token.findall((url if some_whole else short).lower()))
                fetched = [i for t in [*tokens, ""] for i in index.get(t, ())]
                fit = [rules[i] for i in fetched if compiled[i].search(url if rules[i].whole else short)]
                best = min((r for r in fit if r.name), key=lambda r: (-len(r.name), r.name), default=None)
                said = {best.verdict} if best else {r.verdict for r in fit}
                names.append(best.name if best else None)
                verdicts.append("block" if said == {"block"} else "allow")
                tried.append(len(fetched))
            cols = [*(batch.column(c) for c in ("page_id", "host", "path")), pa.array(names, pa.string())]
            cols += [pa.array(verdicts, pa.string()), pa.array(tried, pa.int32())]
            yield pa.record_batch(cols, names=["page_id", "host", "path", "rule", "verdict", "candidates"])

    schema = "page_id long, host string, path string, rule string, verdict string, candidates int"
    return (plain if some_whole else plain.withColumn("url", F.lit(""))).mapInArrow(run, schema)


def op3_url_filters(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages")).drop("candidates")


_hosts, _paths = "|".join(HOST_TERMS), "|".join(PATH_TERMS)
OP3_SQL = rf"""
WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{UPPER}',
  '{LOWER}') AS host,
                  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
f AS (SELECT *, host = 'example.org' OR host LIKE '%.example.org' AS ex, host = 'org' OR host LIKE '%.org' AS org,
  host = 'com' OR host LIKE '%.com' AS com FROM p),
r AS (SELECT *, CASE WHEN ex AND starts_with(path, '/en/1') THEN 'example.org/en/1'
  WHEN ex AND starts_with(path, '/es/') THEN 'example.org/es/'
                     WHEN com AND starts_with(path, '/fr/') THEN 'com/fr/'
                     WHEN com AND starts_with(path, '/de/') THEN 'com/de/'
                     WHEN org AND starts_with(path, '/') THEN 'org/' END AS rule FROM f)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN regexp_matches(host || path, '(?s)^(?:[^/]*[.\-])?(?:{_hosts})[.\-]') OR regexp_matches(host || path,
            '(?s)^[^/]*/(?:.*/)?(?:{_paths})(?:[/.]|$)') THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""
