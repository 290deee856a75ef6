"""URL filtering by pattern rules that are indexed by their rarest literal token."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_within, materialize

#: Fixed values: (host, path, verdict) of the address rules of the registered query.
HOST_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
#: Pattern rules of this method for addresses that no host rule decides; patterns see host and path.
PATTERN_RULES = [
    ("spam-farm", r"^(?:[^/]*\.)?spam-farm\.", "block"),
    ("cheap-pills", r"^(?:[^/]*\.)?cheap-pills\.", "block"),
    ("casino-win", r"^(?:[^/]*\.)?casino-win\.", "block"),
    ("free-bets", r"^(?:[^/]*\.)?free-bets\.", "block"),
    ("ads-track", r"^(?:[^/]*\.)?ads-track\.", "block"),
]
RULE_COLUMNS = ("rule", "pattern", "verdict", "priority", "tokens")
HOST_PRIORITY, PATTERN_PRIORITY = 1_000_000, 0
#: Most rules that every row looks up by itself, and most rows of the rule index that are broadcast; a larger one is joined by a shuffle.
IN_ROW_RULES, BROADCAST_RULES = 500, 100_000


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): host from the first ``://`` up to ``/ ? #`` with A-Z lowered, path from there up to ``? #``.

    Null and addresses without ``://`` give two empty strings.
    """
    rest = F.when(F.locate("://", url) > 0, F.expr("substring(__url, locate('://', __url) + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def host_rule(host: str, path: str, verdict: str) -> dict:
    """A rule that fits ``host`` and its subdomains where the path starts with ``path``.

    Its literal tokens are the labels of the host and those parts of the path that are closed on both
    sides; the longest rule has the highest priority.
    """
    tokens = [t for t in host.split(".") if t] + path.split("/")[1:-1]
    name = host + path
    return {"rule": name, "pattern": rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}", "verdict": verdict, "priority": HOST_PRIORITY + len(name), "tokens": [t for t in tokens if t]}


def pattern_rule(token: str, pattern: str, verdict: str) -> dict:
    """A regular expression over host and path whose every match contains ``token`` as a whole token."""
    return {"rule": f"~{token}", "pattern": pattern, "verdict": verdict, "priority": PATTERN_PRIORITY + len(token), "tokens": [token]}


def rules_frame(spark: SparkSession, rules: list[dict]) -> DataFrame:
    return spark.createDataFrame([tuple(r[k] for k in RULE_COLUMNS) for r in rules], "rule string, pattern string, verdict string, priority int, tokens array<string>")


def url_tokens(host: Column, path: Column) -> Column:
    """Distinct literal tokens of an address: labels of the host, parts of the path, and always the empty token."""
    return F.array_distinct(F.concat(F.array(F.lit("")), F.split(host, r"\."), F.split(path, "/")))


def _rule_index(base: DataFrame, rules: DataFrame) -> DataFrame:
    """Each rule with its rarest literal ``token``, as a written table.

    Only tokens that some rule has are counted, over all addresses; a rule without literal tokens is
    filed under the empty token, which every address has.
    """
    usable = F.when(F.size("tokens") > 0, F.col("tokens")).otherwise(F.array(F.lit("")))
    filed = materialize(rules.select("rule", "pattern", "verdict", "priority", F.explode(usable).alias("token")), "rule-tokens")
    asked = broadcast_within(materialize(filed.select("token").distinct(), "tokens"), BROADCAST_RULES)
    seen = base.select(F.explode(url_tokens(F.col("__host"), F.col("__path"))).alias("token")).join(asked, "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    rarest = F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token"))
    return materialize(filed.join(seen, "token", "left").groupBy("rule", "pattern", "verdict", "priority").agg(rarest.alias("token")), "rules")


def _by_token(index: DataFrame) -> Column:
    """The index as a constant map from tokens to rules, which Spark folds once; of a checked number of rules."""
    found: dict[str, list[dict]] = {}
    for r in index.collect():
        found.setdefault(r.token, []).append({"priority": r.priority, "rule": r.rule, "verdict": r.verdict, "pattern": r.pattern})
    return F.from_json(F.lit(json.dumps(found)), "map<string,array<struct<priority:int,rule:string,verdict:string,pattern:string>>>")


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", in_row: int = IN_ROW_RULES) -> DataFrame:
    """Verdict for each row: the id, ``host, path, rule, verdict``.

    ``rules``: ``rule, pattern, verdict, priority, tokens`` (see :func:`host_rule`). How often each
    token of a rule occurs is counted over all addresses, and a rule is filed under its rarest token. The
    tokens of an address fetch the rules filed under them, and only those run their regular expression.
    Of the rules that match, the highest priority wins (ties: the greater name). Up to ``in_row`` rules
    are a constant map that each row looks its tokens up in, so addresses are never shuffled. More are
    joined to the tokens of different addresses, broadcast up to ``BROADCAST_RULES`` and by a shuffle
    beyond; equal addresses are then judged once, so a hot address is one row of the search.

    Null, empty and malformed addresses have an empty host and path and get ``default`` unless a rule
    matches that. Addresses of any length are judged whole. Repeated rows and ids get a row each; other
    columns are not read. An empty table gives no rows.
    """
    host, path = split_url(F.col("__url"))
    base = pages.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{url_col}`").alias("__url")).select("__id", host.alias("__host"), path.alias("__path"))
    index = _rule_index(base, rules)
    named = [F.col("__id").alias(id_col), F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("__best.rule").alias("rule"), F.coalesce("__best.verdict", F.lit(default)).alias("verdict")]
    if index.limit(in_row + 1).count() <= in_row:
        by_token = _by_token(index)
        fetched = F.transform(url_tokens(F.col("__host"), F.col("__path")), lambda t: F.try_element_at(by_token, t))
        likely = base.withColumn("__rules", F.flatten(F.filter(fetched, lambda r: r.isNotNull())))
        fits = F.filter("__rules", lambda r: F.regexp_like(F.concat("__host", "__path"), r["pattern"]))
        best = F.array_max(F.transform(fits, lambda r: F.struct(r["priority"].alias("priority"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))))
        return likely.withColumn("__best", best).select(*named)

    addresses = base.select("__host", "__path").distinct()
    probes = addresses.withColumn("__token", F.explode(url_tokens(F.col("__host"), F.col("__path"))))
    hits = probes.join(broadcast_within(index, BROADCAST_RULES), F.col("__token") == F.col("token")).filter(F.expr("concat(__host, __path) rlike pattern"))
    best = hits.groupBy("__host", "__path").agg(F.max(F.struct("priority", "rule", "verdict")).alias("__best"))
    best = materialize(best, "verdicts")  # a plain table, so that Spark can split the join of a hot address
    judged = base.join(best.toDF("__h", "__p", "__best"), (F.col("__host") == F.col("__h")) & (F.col("__path") == F.col("__p")), "left")
    return judged.select(*named)


def op6_url_filter(spark, sf_dir):
    """The fixed host rules, and this method's own pattern rules for what they leave open."""
    rules = [host_rule(*r) for r in HOST_RULES] + [pattern_rule(*r) for r in PATTERN_RULES]
    judged = filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules_frame(spark, rules))
    return judged.withColumn("rule", F.when(~F.col("rule").startswith("~"), F.col("rule")))


OP6_SQL = r"""
WITH u AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (SELECT *, CASE
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule FROM p)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('org/', 'com/fr/') THEN 'allow'
    WHEN rule IS NOT NULL THEN 'block'
    WHEN regexp_matches(host || path, '^([^/]*\.)?(spam-farm|cheap-pills|casino-win|free-bets|ads-track)\.') THEN 'block'
    ELSE 'allow' END AS verdict
FROM r
"""
