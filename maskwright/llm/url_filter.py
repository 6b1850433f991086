"""URL rules, each indexed by its rarest literal token.

A rule is a regular expression on host + path, with literal tokens that every match must contain. How
often those tokens occur in the urls decides which one is the rule's key. A url's tokens fetch the
rules under their keys, and only those run their expression; most urls run none or a few.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm import common as C

TOKEN = "[a-z0-9]+"
_tokens = re.compile(TOKEN).findall
_UPPER_TO_LOWER = str.maketrans(C.UPPER, C.LOWER)


@dataclass(frozen=True)
class Rule:
    """``tokens``: lower-case runs of letters a-z and digits that stand alone in every url that matches."""

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    named: bool = False  # reported as the url's rule; the longest such rule wins over all others


def under(host: str, path: str, verdict: str) -> Rule:
    """A rule for a host and its subdomains, where the path starts with ``path``.

    Only path segments closed by a slash count as tokens: the last one may go on in the url.
    """
    closed = path.rpartition("/")[0]
    return Rule(host + path, verdict, rf"\A(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}", tuple(_tokens(host)) + tuple(_tokens(closed)), True)


# The rules of the query.
NAMED = (under("net", "/", "block"), under("example.net", "/en/", "allow"), under("example.com", "/de/", "block"), under("org", "/fr/", "allow"))

# Patterns for urls that no named rule decides; what matches none is allowed.
PATTERNS = (
    Rule("bets", "block", r"\A[^/]*\bfree-bets\b", ("free", "bets")),
    Rule("link farms", "block", r"\A[^/]*\bspam-farm\b", ("spam", "farm")),
    Rule("casinos", "block", r"\A[^/]*\bcasino\b", ("casino",)),
    Rule("adult", "block", r"\A[^/]*\b(?:xxx|porn)\.", ()),
)


def host_and_path(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    return host.translate(_UPPER_TO_LOWER), re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]


def token_counts(urls: DataFrame, rules: tuple[Rule, ...], url: str) -> dict[str, int]:
    """How many urls hold each token of the rules; the rules bound the number of rows."""
    wanted = sorted({t for r in rules for t in r.tokens})
    tokens = F.array_distinct(F.regexp_extract_all(F.lower(F.col(url)), F.lit(TOKEN), F.lit(0)))
    counted = urls.select(F.explode(F.array_intersect(tokens, F.array(*[F.lit(t) for t in wanted]).cast("array<string>"))).alias("token")).groupBy("token").count()
    return {r["token"]: r["count"] for r in counted.collect()}


class Index:
    def __init__(self, rules: tuple[Rule, ...], counts: dict[str, int]) -> None:
        self.by_token: dict[str, list[tuple[Rule, re.Pattern]]] = {}
        self.always: list[tuple[Rule, re.Pattern]] = []
        for rule in rules:
            entry = (rule, re.compile(rule.pattern))
            if rule.tokens:
                self.by_token.setdefault(min(rule.tokens, key=lambda t: (counts.get(t, 0), t)), []).append(entry)
            else:
                self.always.append(entry)

    def judge(self, host: str, path: str) -> tuple[str | None, str, str | None]:
        """The named rule that wins, the verdict, and the pattern that gave it where no rule did."""
        target = host + path
        candidates = list(self.always)
        for token in set(_tokens(target.lower())):
            candidates += self.by_token.get(token, ())
        hits = [rule for rule, pattern in candidates if pattern.search(target)]
        named = [r for r in hits if r.named]
        if named:
            best = max(named, key=lambda r: (len(r.name), r.name))
            return best.name, best.verdict, None
        blocking = sorted(r.name for r in hits if r.verdict == "block")
        return (None, "block", blocking[0]) if blocking else (None, "allow", None)


def judged(urls: DataFrame, rules: tuple[Rule, ...], key: str = "page_id", url: str = "url") -> DataFrame:
    """One row per row of ``urls``: the key, host, path, rule, verdict and pattern.

    A null url or one without ``://`` has an empty host and path, matches no rule and is allowed.
    """
    counts = token_counts(urls, rules, url)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(rules, counts)
        for batch in batches:
            places = [host_and_path(u) for u in batch.column(1).to_pylist()]
            found = [index.judge(*p) for p in places]
            columns = [[p[0] for p in places], [p[1] for p in places], *[[f[i] for f in found] for i in range(3)]]
            yield pa.record_batch([batch.column(0), *[pa.array(c, pa.string()) for c in columns]], ["page_id", "host", "path", "rule", "verdict", "pattern"])

    rows = urls.select(F.col(key).cast("bigint").alias("page_id"), F.col(url).cast("string").alias("url"))
    return rows.mapInArrow(run, "page_id bigint, host string, path string, rule string, verdict string, pattern string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: every page's url."""
    C.ship(spark)
    return judged(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"), NAMED + PATTERNS)


SQL = r"""
    WITH u AS (
        SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
    ), p AS (
        SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
               regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
        FROM u
    ), r AS (
        SELECT *, '.' || host AS dotted,
               CASE WHEN (dotted LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
                    WHEN (dotted LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
                    WHEN (dotted LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
                    WHEN (dotted LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule,
               CASE WHEN regexp_matches(host, '(^|[^a-z0-9_])free-bets([^a-z0-9_]|$)') THEN 'bets'
                    WHEN regexp_matches(host, '(^|[^a-z0-9_])casino([^a-z0-9_]|$)') THEN 'casinos'
                    WHEN regexp_matches(host, '(^|[^a-z0-9_])spam-farm([^a-z0-9_]|$)') THEN 'link farms'
                    WHEN regexp_matches(host, '(^|[^a-z0-9_])(xxx|porn)\.') THEN 'adult' END AS found
        FROM p
    )
    SELECT page_id, host, path, rule,
           CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
                WHEN found IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
           CASE WHEN rule IS NULL THEN found END AS pattern
    FROM r
"""
