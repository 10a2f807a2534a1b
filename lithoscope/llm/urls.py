"""Operator 3, URL filter: host-suffix and path-prefix expressions against rules, by short hash and full digest.

Each URL is expanded into the expressions ``host suffix + path prefix`` that a rule could name. Only as many labels and
only such path lengths as some rule has are expanded, so the number of expressions of a URL is bounded by the rules. The
expressions meet the rules in an equi-join on the first four bytes of their SHA-256; a hit counts only if the whole
digests agree. Of the hits the longest rule wins, then the longer host, then ``block``.

Edge cases: a null URL or one without ``://`` has an empty host and an empty path and fits no rule; a rule whose path is
``/`` doesn't fit a URL with an empty path; repeated rows are judged alike and all stay; an empty table gives no rows;
columns besides ``page_id`` and ``url`` are not read, so clashing names do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lithoscope.llm.common import read

#: Rules up to this number are sent to all executors; more are joined by shuffles.
BROADCAST_RULES = 100_000
#: Distinct path lengths up to which only those are expanded; beyond it, every prefix of a path is.
FEW_LENGTHS = 4_096

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty if there is none."""
    raw = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty if there is no ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def expressions(host: Column, path: Column, labels: int, lengths: list[int] | None) -> Column:
    """Array of ``host suffix + path prefix`` strings with at most ``labels`` labels and with paths of ``lengths`` (or all)."""
    parts = F.split(host, r"\.", -1)
    suffixes = F.transform(
        F.sequence(F.lit(1), F.least(F.size(parts), F.lit(labels))),
        lambda k: F.array_join(F.slice(parts, F.size(parts) - k + 1, k), "."),
    )
    suffixes = F.filter(suffixes, lambda s: s != "")
    own = F.filter(F.lit(lengths) if lengths is not None else F.sequence(F.lit(0), F.length(path)), lambda n: n <= F.length(path))
    prefixes = F.transform(own, lambda n: F.substring(path, F.lit(1), n))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p)))))


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """``page_id, host, path, rule, verdict`` for each row of ``pages(page_id, url)`` under ``rules(host, path, verdict)``.

    ``rule`` is null and ``verdict`` is ``default`` where no rule fits. The rules' sizes (their number, the most labels,
    the distinct path lengths) are looked up first; only a set of at most ``BROADCAST_RULES`` rules is broadcast.
    """
    rules = rules.where(F.col("host").isNotNull() & F.col("path").isNotNull()).select("host", "path", "verdict")
    size = rules.agg(
        F.count("*").alias("n"), F.max(F.size(F.split("host", r"\.", -1))).alias("labels"), F.count_distinct(F.length("path")).alias("lengths")
    ).first()
    judged = pages.select("page_id", "url").withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))}).drop("url")
    empty = judged.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    if not size["n"]:
        return empty
    expression = F.concat("host", "path")
    keyed = rules.select(
        F.sha2(expression, 256).alias("rule_digest"), expression.alias("rule"), F.length("host").alias("host_length"), "verdict"
    ).withColumn("rule_key", F.substring("rule_digest", 1, 8))
    broadcastable = size["n"] <= BROADCAST_RULES
    lengths = sorted(r["n"] for r in rules.select(F.length("path").alias("n")).distinct().collect()) if size["lengths"] <= FEW_LENGTHS else None
    hits = (
        judged.where(F.col("host") != "").select("host", "path").distinct()
        .withColumn("expression", F.explode(expressions(F.col("host"), F.col("path"), size["labels"], lengths)))
        .withColumn("digest", F.sha2("expression", 256)).drop("expression")
        .withColumn("key", F.substring("digest", 1, 8))
        .join(F.broadcast(keyed) if broadcastable else keyed, F.col("key") == F.col("rule_key"))
        .where(F.col("digest") == F.col("rule_digest"))
    )
    precedence = F.struct(F.length("rule"), "host_length", F.col("verdict") == "block")
    best = hits.groupBy("host", "path").agg(F.max_by(F.struct("rule", "verdict"), precedence).alias("best"))
    found = judged.where(F.col("host") != "").join(best, ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )
    return found.unionByName(empty.where(F.col("host") == ""))  # rows without a host share one key, and meet no rule


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``pages`` under the four rules of the contract."""
    return filter_urls(read(spark, sf_dir, "pages"), spark.createDataFrame(RULES, "host string, path string, verdict string"))


OP3_SQL = r"""
WITH judged AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
rules(rule_host, rule_path, rule_verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
pairs AS (SELECT DISTINCT host, path FROM judged),
best AS (
  SELECT host, path,
         arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
         arg_max(rule_verdict, length(rule_host || rule_path)) AS verdict
  FROM pairs JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY host, path)
SELECT judged.page_id, judged.host, judged.path, best.rule, coalesce(best.verdict, 'allow') AS verdict
FROM judged LEFT JOIN best ON judged.host = best.host AND judged.path = best.path
"""
