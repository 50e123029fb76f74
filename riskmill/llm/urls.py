"""URL filters: rules indexed by their rarest literal token. DataFrame only.

A rule is a regular expression with the literal tokens (runs of a-z and 0-9, lower case) that every matching url has.
How many urls hold each of these tokens is counted over all urls, and each rule is filed under its rarest one. The
tokens of a url fetch the rules filed under them; only those rules run their expression. A rule none of whose tokens
occurs is tried on no url. One without any token is tried on every url; none of the rules below is of this kind, an
alternation of literals is a rule for each.

Host rules fit a host and its subdomains when the path starts with the rule's path; the longest wins. Where none
fits, pattern rules over the whole url decide, the longest pattern first, and last the default verdict.

A null url, or one without ``://``, has an empty host and path and gets the default verdict unless a pattern fits.
Urls of any length are read whole. Repeated urls are judged once and joined back, so repeated pages keep all their rows.
Further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskmill.lineage import cut_lineage
from riskmill.llm.common import BROADCAST_KEYS

TOKEN_BREAK = "[^a-z0-9]+"
DEFAULT_VERDICT = "allow"


@dataclass(frozen=True)
class UrlRule:
    name: str
    regex: str
    tokens: tuple[str, ...]
    verdict: str
    by_host: bool = False


def host_rule(site: str, verdict: str) -> UrlRule:
    """A rule like ``example.com/en/``: the host with all subdomains, and the beginning of the path."""
    # What follows the last break of the path may go on in a url, so it is no whole token.
    whole = site[:len(site) - len(re.split("[^A-Za-z0-9]", site)[-1])] if "/" in site else site
    tokens = tuple(sorted({t for t in re.split(TOKEN_BREAK, whole.lower()) if t}))
    return UrlRule(site, r"^([^/]*\.)?" + re.sub(r"([^A-Za-z0-9/])", r"\\\1", site), tokens, verdict, True)


SITE_RULES = (host_rule("com/", "allow"), host_rule("example.com/en/", "block"), host_rule("www.example.com/en/", "allow"),
              host_rule("net/es/", "block"), host_rule("net/fr/", "block"))
# Pages that repeat others or hold no prose, wherever they are.
PATTERN_RULES = (
    UrlRule("paged-referral", r"[?&]page=[0-9]+&ref=", ("page", "ref"), "block"),
    UrlRule("session", r"[?&;]sid=", ("sid",), "block"),
    UrlRule("php-session", r"[?&;]phpsessid=", ("phpsessid",), "block"),
    UrlRule("java-session", r"[?&;]jsessionid=", ("jsessionid",), "block"),
    UrlRule("log-in", r"/login(?:[/?#.]|$)", ("login",), "block"),
    UrlRule("sign-in", r"/signin(?:[/?#.]|$)", ("signin",), "block"),
    UrlRule("shopping-cart", r"/cart(?:[/?#.]|$)", ("cart",), "block"),
    UrlRule("feed-article", r"[?&]utm_source=feed(?:[&#]|$)", ("utm", "source", "feed"), "allow"),
)


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1),
                       "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def judge_urls(pages: DataFrame, rules: Sequence[UrlRule] = SITE_RULES + PATTERN_RULES,
               default: str = DEFAULT_VERDICT) -> DataFrame:
    """One row per page: page_id, host, path, rule (of a host rule), verdict, pattern (that decided instead)."""
    found = cut_lineage(_best_rules(pages.select("url").where("url is not null").distinct(), rules))
    host_verdict = F.when(F.col("by_host"), F.col("rule_name"))
    return pages.select("page_id", "url").join(found, "url", "left").select(
        "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"),
        host_verdict.alias("rule"), F.coalesce("verdict", F.lit(default)).alias("verdict"),
        F.when(~F.col("by_host"), F.col("rule_name")).alias("pattern"))


def _best_rules(urls: DataFrame, rules: Sequence[UrlRule]) -> DataFrame:
    spark = urls.sparkSession
    schema = "rule_name string, regex string, tokens array<string>, verdict string, by_host boolean"
    listed = spark.createDataFrame([(r.name, r.regex, list(r.tokens), r.verdict, r.by_host) for r in rules], schema)
    small = F.broadcast if sum(len(r.tokens) + 1 for r in rules) <= BROADCAST_KEYS else (lambda frame: frame)
    tokens = urls.select("url", F.explode(F.array_distinct(F.filter(
        F.split(F.lower("url"), TOKEN_BREAK), lambda t: t != ""))).alias("token"))
    wanted = listed.select(F.explode("tokens").alias("token")).distinct()
    counted = cut_lineage(tokens.join(small(wanted), "token").groupBy("token").agg(F.count("*").alias("n_urls")))
    filed = listed.withColumn("token", F.explode("tokens")).join(counted, "token", "left") \
        .groupBy("rule_name", "regex", "verdict", "by_host") \
        .agg(F.min(F.struct(F.coalesce("n_urls", F.lit(0)).alias("n"), "token")).alias("rarest")) \
        .select("rule_name", "regex", "verdict", "by_host", F.col("rarest.token").alias("token"))
    fetched = tokens.join(small(filed), "token").drop("token")
    if any(not rule.tokens for rule in rules):
        # Each url meets the few rules that have no literal; the list is short and comes from the caller.
        everywhere = [F.struct(F.lit(r.name).alias("rule_name"), F.lit(r.regex).alias("regex"),
                               F.lit(r.verdict).alias("verdict"), F.lit(r.by_host).alias("by_host"))
                      for r in rules if not r.tokens]
        tried = urls.select("url", F.explode(F.array(*everywhere)).alias("r")).select("url", "r.*")
        fetched = fetched.unionByName(tried.select(*fetched.columns))
    subject = F.when(F.col("by_host"), F.concat(host_of(F.col("url")), path_of(F.col("url")))).otherwise(F.lower("url"))
    fits = fetched.where(F.rlike(subject, F.col("regex")))
    return fits.groupBy("url").agg(F.max(F.struct(
        "by_host", F.length(F.when(F.col("by_host"), F.col("rule_name")).otherwise(F.col("regex"))).alias("length"),
        "rule_name", "verdict")).alias("best")).select("url", "best.by_host", "best.rule_name", "best.verdict")
