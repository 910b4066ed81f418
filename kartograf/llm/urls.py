"""URL filters: pattern rules found by their rarest literal token.  DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kartograf.llm.base import ascii_lower, stored

#: A rule table of up to this many rows is sent to all executors; a larger one is joined.
MOST_BROADCAST_RULES = 100_000

#: Rules on host and path prefix: (verdict, host, path).  Fixed values.
PATH_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
#: Rules for all other addresses: (verdict, pattern of host and path, ``*`` stands for any characters).
GLOB_RULES = [
    ("block", "ads.*"),
    ("block", "*.ads.*"),
    ("block", "track.*"),
    ("block", "*.doubleclick.*"),
    ("block", "*/login/*"),
    ("block", "*/signin/*"),
    ("block", "*/cart/*"),
    ("block", "*/checkout/*"),
    ("block", "*/casino/*"),
    ("block", "*/tag/*/page/*"),
    ("block", "*.exe"),
    ("block", "*.zip"),
    ("block", "*.jpg"),
    ("block", "*.png"),
    ("allow", "*/wiki/*"),
]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host in lower case (A-Z) and path of an address; both empty without ``://``."""
    shape = r"(?s)^.*?://([^/?#]*)(/[^?#]*)?"
    text = F.coalesce(url, F.lit(""))
    return ascii_lower(F.regexp_extract(text, shape, 1)), F.regexp_extract(text, shape, 2)


def rule_table(spark: SparkSession, path_rules=PATH_RULES, glob_rules=GLOB_RULES) -> DataFrame:
    rows = [(v, host + path, True) for v, host, path in path_rules] + [(v, glob, False) for v, glob in glob_rules]
    return spark.createDataFrame(rows, "verdict string, rule string, on_path boolean")


def compiled(rules: DataFrame) -> DataFrame:
    """Adds the regular expression of each rule and the tokens that every match contains whole."""
    quoted = F.regexp_replace("rule", r"([^A-Za-z0-9*])", r"\\$1")
    on_path = F.concat(F.lit(r"(?s)^(?:[^/]*\.)?"), F.regexp_replace(quoted, r"\*", r"\\*"))
    glob = F.concat(F.lit("(?s)^"), F.regexp_replace(quoted, r"\*", ".*"), F.lit("$"))
    # no "/" before the host of a prefix rule: a host name in the path is not the address's host
    # the end of a prefix rule may stand within a token, the end of a glob may not
    text = F.when(F.col("on_path"), ascii_lower(F.col("rule"))).otherwise(F.concat(ascii_lower(F.col("rule")), F.lit("$")))
    wild = F.when(F.col("on_path"), F.lit(r"(?<![a-z0-9])([a-z0-9]+)(?=[^a-z0-9])")).otherwise(F.lit(r"(?<![a-z0-9*])([a-z0-9]+)(?=[^a-z0-9*])"))
    return rules.select("*", F.when(F.col("on_path"), on_path).otherwise(glob).alias("regex"),
                        F.array_distinct(F.regexp_extract_all(text, wild, F.lit(1))).alias("tokens"))


def _address_tokens(addresses: DataFrame) -> DataFrame:
    """(url, key, token): the distinct tokens of host and path, and an empty one for rules without token."""
    tokens = F.split(ascii_lower(F.col("key")), "[^a-z0-9]+")
    return addresses.select("url", "key", F.explode(F.array_distinct(F.concat(tokens, F.array(F.lit(""))))).alias("token"))


def _near(rules: DataFrame) -> DataFrame:
    """Broadcast after its size was counted, or as it is."""
    return F.broadcast(rules) if rules.count() <= MOST_BROADCAST_RULES else rules


def indexed(rules: DataFrame, tokens: DataFrame) -> DataFrame:
    """Rules with the one token they are fetched by: the rarest among the addresses (ties: the first in order)."""
    listed = rules.select("rule", F.explode("tokens").alias("token"))
    known = _near(listed.select("token").distinct())
    counts = tokens.join(known, "token").groupBy("token").agg(F.count("*").alias("n"))
    best = listed.join(counts, "token", "left").groupBy("rule").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token"))["token"].alias("token"))
    return rules.join(best, "rule", "left").select("rule", "verdict", "on_path", "regex", F.coalesce("token", F.lit("")).alias("token"))


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """(id_col, host, path, rule, verdict, pattern), one row per input row.

    Distinct addresses are judged once.  Each fetches the rules whose rarest token it contains, and
    only these run their regular expression.  A rule on host and path goes before patterns; among
    rules of a kind the longest wins, then the first in order.  Without a rule the verdict is
    ``default``.  NULL addresses and those without ``://`` have an empty host and path and fit only
    patterns that fit an empty text.  Repeated rows are judged alike; other columns are not read.
    """
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), host.alias("host"), path.alias("path"))
    addresses = rows.select("url", F.concat("host", "path").alias("key")).distinct()
    tokens = _address_tokens(addresses)
    index = _near(stored(indexed(compiled(rules.dropDuplicates(["rule", "on_path"])), tokens), "rules"))
    fits = tokens.join(index, "token").filter(F.expr("regexp_like(key, regex)"))
    best = fits.groupBy("url").agg(F.min(F.struct((~F.col("on_path")).alias("late"), (-F.length("rule")).alias("size"), "rule", "verdict")).alias("b"))
    best = stored(best.select(F.col("url").alias("_url"), "b.late", "b.rule", "b.verdict"), "verdicts")
    return rows.join(best, F.col("url") == F.col("_url"), "left").select(
        F.col("id").alias(id_col), "host", "path", F.when(~F.col("late"), F.col("rule")).alias("rule"),
        F.coalesce("verdict", F.lit(default)).alias("verdict"), F.when(F.col("late"), F.col("rule")).alias("pattern"))
