"""URL filters: rules found by their rarest literal token.

A URL is a host (after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
lower-cased) and a path (then up to ``?``, ``#`` or the end).  There are two kinds
of rules: ``place`` rules name a host and the beginning of a path and hold for the
host and its subdomains; ``pattern`` rules are regular expressions over host +
path.  Each becomes one regular expression, filed under that one of its whole
literal tokens (runs of letters and digits that the rule bounds on both sides)
which is rarest among the tokens of all URLs.  A URL's tokens fetch the rules
filed under them, and only those are run; rules without a whole token are run on
every URL.  The verdict is that of the longest place rule that fits, else ``block``
if a pattern rule fits, else ``allow``.

Token counts are a grouped sum over all URLs, of the rules' tokens only.  Rules
are broadcast in blocks of at most ``RULES`` rules, applied one after the other
in the same partitions, so nothing is shuffled and a common host has no task of
its own.

Defined results: a null URL or one without ``://`` has an empty host and path, no
rule and the verdict ``allow``; repeated rows are judged alone; equally long place
rules: the one that blocks, then the first in order; no rows or no rules give no
rows or ``allow``; other columns are kept, except those named like a result, which
are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RULES = 100_000
_TOKEN = re.compile(r"[a-z0-9]+")


@dataclass(frozen=True)
class Rule:
    """``kind``: place or pattern. ``name`` is what results show. ``expression`` is searched in host + path."""

    kind: str
    name: str
    verdict: str
    expression: str
    tokens: tuple[str, ...]


def place(host: str, path: str, verdict: str) -> Rule:
    """``path`` begins with a slash. Its last token is whole only if something bounds it."""
    whole = host.lower() + path.lower()
    tokens = [m.group() for m in _TOKEN.finditer(whole) if m.end() < len(whole)]
    return Rule("place", host + path, verdict, rf"^(?:[^/]*\.)?{re.escape(host.lower())}{re.escape(path)}", tuple(tokens))


def pattern(expression: str, *tokens: str) -> Rule:
    """``tokens``: whole lower-case tokens that every text with a match has."""
    return Rule("pattern", expression, "block", expression, tokens)


#: Rules of the query (fixed values of its contract).
PLACES = [
    place("com", "/", "allow"),
    place("example.com", "/en/", "block"),
    place("www.example.com", "/en/", "allow"),
    place("net", "/es/", "block"),
    place("net", "/fr/", "block"),
]
#: Kinds of hosts that a corpus leaves out.
PATTERNS = [
    pattern(r"(^|\.)ads?-track\.", "track"),
    pattern(r"(^|[.-])adult-", "adult"),
    pattern(r"(^|[.-])casino-", "casino"),
    pattern(r"(^|[.-])spam-farm\.", "farm", "spam"),
    pattern(r"(^|[.-])cheap-pills\.", "cheap", "pills"),
    pattern(r"(^|[.-])free-bets\.", "bets", "free"),
]


def with_parts(urls: DataFrame, url: str = "url") -> DataFrame:
    """``urls`` with host and path."""
    raw = F.coalesce(F.col(url), F.lit(""))
    host = F.regexp_extract(raw, r"(?s)^.*?://([^/?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return urls.withColumns({"host": F.translate(host, upper, lower), "path": F.regexp_extract(raw, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)})


def token_counts(parts: DataFrame, rules: list[Rule]) -> dict[str, int]:
    """In how many URLs each token of the rules occurs; one row for each such token reaches the driver."""
    spark = parts.sparkSession
    wanted = spark.createDataFrame([(t,) for t in sorted({t for r in rules for t in r.tokens})], "token string")
    tokens = parts.select(F.explode(F.array_distinct(F.split(F.lower(F.concat("host", "path")), "[^a-z0-9]+"))).alias("token"))
    few = F.broadcast(wanted) if len(rules) <= RULES else wanted
    counts = tokens.join(few, "token").groupBy("token").count()
    return {r["token"]: r["count"] for r in counts.collect()}


def filed(rules: list[Rule], counts: dict[str, int]) -> dict[str, list[int]]:
    """Numbers of rules under their rarest token; those without one under the empty token."""
    index: dict[str, list[int]] = {}
    for k, rule in enumerate(rules):
        index.setdefault(min(rule.tokens, key=lambda t: (counts.get(t, 0), t), default=""), []).append(k)
    return index


def _better(new: Rule, old: Rule | None) -> bool:
    return old is None or (len(new.name), new.verdict == "block") > (len(old.name), old.verdict == "block")


def judge(urls: DataFrame, rules: list[Rule], url: str = "url", block: int = RULES) -> DataFrame:
    """``urls`` with host, path, rule (the place rule that decides, or null), verdict and pattern (the first pattern rule that fits, or null)."""
    spark = urls.sparkSession
    parts = with_parts(urls, url)
    counts = token_counts(parts, rules) if rules else {}
    parts = parts.withColumns({k: F.lit(None).cast("string") for k in ("rule", "verdict", "pattern")})
    for at in range(0, len(rules), block):
        own = rules[at : at + block]
        sent = spark.sparkContext.broadcast((own, filed(own, counts)))
        parts = parts.mapInArrow(_judged(sent), parts.schema)
    return parts.withColumn("verdict", F.coalesce("verdict", F.when(F.col("pattern").isNotNull(), "block").otherwise("allow")))


class _Searches(dict):
    """Each rule's search, compiled when a URL first asks for it."""

    def __init__(self, rules: list[Rule]):
        self.rules = rules

    def __missing__(self, n: int):
        self[n] = re.compile(self.rules[n].expression).search
        return self[n]


def _judged(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, index = sent.value
        search = _Searches(own)
        always = index.get("", [])
        for batch in batches:
            rules, verdicts, patterns = (batch.column(k).to_pylist() for k in ("rule", "verdict", "pattern"))
            for k, (host, path) in enumerate(zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True)):
                text = host + path
                best = None if rules[k] is None else Rule("place", rules[k], verdicts[k], "", ())
                for n in [*always, *(n for t in dict.fromkeys(_TOKEN.findall(text.lower())) for n in index.get(t, ()))]:
                    rule = own[n]
                    if rule.kind == "pattern":
                        if patterns[k] is None and search[n](text):
                            patterns[k] = rule.name
                    elif _better(rule, best) and search[n](text):
                        best = rule
                if best is not None:
                    rules[k], verdicts[k] = best.name, best.verdict
            made = {"rule": rules, "verdict": verdicts, "pattern": patterns}
            columns = [pa.array(made[f.name], f.type) if f.name in made else batch.column(i) for i, f in enumerate(batch.schema)]
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return run


def keep_allowed(urls: DataFrame, rules: list[Rule], url: str = "url") -> DataFrame:
    """``urls`` without those that are blocked, with host, path, rule, verdict and pattern."""
    return judge(urls, rules, url).filter("verdict = 'allow'")


def op5_urls(spark, sf_dir: str) -> DataFrame:
    """Every page's URL, judged."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages, PLACES + PATTERNS).select("page_id", "host", "path", "rule", "verdict")


OP5_SQL = r"""
WITH p AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), r(host, path, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
best AS (
  SELECT p.host, p.path, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.verdict, length(r.host || r.path)) AS verdict
  FROM (SELECT DISTINCT host, path FROM p) p JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
  GROUP BY ALL
)
SELECT page_id, p.host, p.path, rule, coalesce(verdict, CASE WHEN regexp_matches(p.host || p.path, '(^|\.)ads?-track\.|(^|[.-])adult-|(^|[.-])casino-|(^|[.-])spam-farm\.|(^|[.-])cheap-pills\.|(^|[.-])free-bets\.') THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN best ON p.host = best.host AND p.path = best.path
"""

QUERIES = {"op5_urls": op5_urls}
SQL = {"op5_urls": OP5_SQL}
