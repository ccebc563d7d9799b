"""URL filtering by pattern rules that are indexed by their rarest literal token.

A rule is a regular expression over ``host + path`` with the literal tokens that every match contains.
The index files each rule under that one of its tokens which fewest URLs of the table contain. A URL's
tokens fetch the rules filed under them, and only those rules run their expressions.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.llm.common import unused

RULES = "rule string, verdict string, pattern string, tokens array<string>, weight int"
#: Weight of the host rules: above every other pattern rule, and by length among themselves.
HOST_RULE = 1_000_000
#: Text of a rule list that Spark may ship as one local table.
MAX_RULE_BYTES = 64 << 20


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def tokens_of(column: Column) -> Column:
    """Runs of ASCII letters and digits, in lower case, each once."""
    return F.array_distinct(F.filter(F.split(F.lower(column), "[^a-z0-9]+"), lambda t: t != ""))


def host_rule(verdict: str, host: str, path: str = "/") -> tuple:
    """A rule for a host with all its subdomains and the paths that start with ``path``; the longest wins."""
    if not host or not path.startswith("/"):
        raise ValueError("A host rule needs a host and a path from the root")
    tokens = re.findall("[a-z0-9]+", host.lower())
    # A path may end inside a token of the URL: only tokens that are closed on both sides are literal.
    tokens += re.findall("(?<=[^a-z0-9])[a-z0-9]+(?=[^a-z0-9])", path.lower())
    pattern = rf"(?s)\A(?:[^/]*\.)?{re.escape(host.lower())}{re.escape(path)}"
    return (host.lower() + path, verdict, pattern, tokens, HOST_RULE + len(host) + len(path))


def pattern_rule(verdict: str, pattern: str, tokens: list[str], weight: int = 0) -> tuple:
    """A rule for URLs whose host and path hold a match; ``tokens`` are whole tokens of every match."""
    if not tokens or any(not re.fullmatch("[a-z0-9]+", t) for t in tokens):
        raise ValueError("A pattern rule needs literal tokens of lower-case letters and digits")
    if not 0 <= weight < HOST_RULE:
        raise ValueError("Weight out of range")
    return (pattern, verdict, pattern, tokens, weight)


def rule_table(spark: SparkSession, rules: list[tuple]) -> DataFrame:
    if sum(len(str(r)) for r in rules) > MAX_RULE_BYTES:
        raise ValueError("Pass a rule list of this size as a table")
    return spark.createDataFrame(rules, RULES)


def rule_index(rules: DataFrame, urls: DataFrame) -> DataFrame:
    """Each rule under its rarest token among ``urls`` (one row per distinct ``url`` with ``tokens``).

    Tokens that no URL holds are rarest of all; ties go to the first in alphabetical order.
    """
    named = rules.withColumn("tokens", F.array_distinct("tokens")).withColumn("token", F.explode("tokens"))
    wanted = named.select("token").distinct()
    counts = urls.select(F.explode("tokens").alias("token")).join(wanted, "token").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    scored = named.join(counts, "token", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return scored.groupBy("rule", "verdict", "pattern", "weight").agg(F.min(F.struct("n", "token"))["token"].alias("token"))


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with ``host, path, rule, verdict``; of the rules that match, the greatest weight wins.

    Ties go to the smallest rule name. Each distinct host and path is judged once, so a hot page costs one
    row. A URL that is null or has no ``://`` has an empty host and path, no rule, and the default verdict.
    Rows of ``pages`` that repeat all stay; its columns named like the four new ones are replaced. Empty
    tables, of pages or of rules, are no special case.
    """
    rows = pages.drop(*{"host", "path", "rule", "verdict"} - {url})
    given = rows.columns
    host, path, whole, found = (unused(pages, name) for name in ("__host", "__path", "__url", "__best"))
    rows = rows.withColumns({host: host_of(pages[url]), path: path_of(pages[url])})
    # "/" cannot occur in a host, so host and path are found again in their concatenation.
    rows = rows.withColumn(whole, F.concat(host, path))
    urls = rows.select(whole).distinct().withColumn("tokens", tokens_of(F.col(whole)))
    index = rule_index(rules, urls)
    fetched = urls.select(whole, F.explode("tokens").alias("token")).join(index, "token")
    matched = fetched.where(F.rlike(whole, "pattern"))
    best = matched.groupBy(whole).agg(F.min(F.struct((-F.col("weight")).alias("w"), "rule", "verdict")).alias(found))
    return rows.join(best, whole, "left").select(
        *[F.col(f"`{c}`") for c in given if c not in ("host", "path", "rule", "verdict")],
        F.col(host).alias("host"),
        F.col(path).alias("path"),
        F.col(f"{found}.rule").alias("rule"),
        F.coalesce(F.col(f"{found}.verdict"), F.lit(default)).alias("verdict"),
    )
