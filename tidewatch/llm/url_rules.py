"""URL filters: a rule list indexed by each rule's rarest literal token.

Every URL yields its tokens, tokens fetch candidate rules through an equi-join with
the index, and only these candidates run their regular expression.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import ascii_lower, first_columns

_TOKEN_GAP = "[^a-z0-9]+"


def literal_tokens(text: str) -> list[str]:
    """Lower-case ASCII letter/digit runs."""
    return re.findall("[a-z0-9]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


@dataclass(frozen=True)
class UrlRule:
    """``pattern`` runs on host + path (host lower-cased; the path starts at the first '/').
    ``literals`` are whole tokens that every matching URL contains."""
    name: str
    verdict: str
    pattern: str
    literals: tuple[str, ...] = field(default=())
    is_prefix: bool = False


def prefix_rule(text: str, verdict: str) -> UrlRule:
    """``host/path`` rule: this host and its subdomains, paths that start with ``/path``."""
    host, _, path = text.partition("/")
    tokens = literal_tokens(host)
    # a path's last token counts only if the rule ends it; else it may be the start of a longer one
    in_path = literal_tokens(path)
    if in_path and re.search("[A-Za-z0-9]$", path):
        in_path = in_path[:-1]
    pattern = "^([^/]*\\.)?" + _quoted(host) + "/" + _quoted(path)
    return UrlRule(text, verdict, pattern, tuple(tokens + in_path), True)


def _quoted(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9/_-])", r"\\\1", text)


def pattern_rule(name: str, verdict: str, pattern: str, *literals: str) -> UrlRule:
    return UrlRule(name, verdict, pattern, tuple(literals))


#: Production list: block rules for hosts of unwanted sites.
SITE_RULES = tuple(
    pattern_rule(f"{a}-{b}", "block", f"^([^/]*\\.)?{a}-{b}\\.", a, b)
    for a, b in (("cheap", "pills"), ("free", "bets"), ("ads", "track"), ("spam", "farm"),
                 ("casino", "win"), ("adult", "x"))
) + (
    pattern_rule("login page", "block", "/(?:login|signin)(?:/|\\.|$)", "login"),
    pattern_rule("sign-in page", "block", "/signin(?:/|\\.|$)", "signin"),
    pattern_rule("shopping cart", "block", "/cart(?:/|\\.|$)", "cart"),
)


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path); both empty for null or without '://'."""
    pattern = "(?s)^.*?://([^/?#]*)([^?#]*)"
    part = lambda n: F.coalesce(F.regexp_extract(url, pattern, n), F.lit(""))
    return ascii_lower(part(1)), part(2)


def _rule_table(spark: SparkSession, rules: list[UrlRule]) -> DataFrame:
    rows = [F.struct(F.lit(i).alias("rule_no"), F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"),
                     F.lit(r.pattern).alias("pattern"), F.lit(int(r.is_prefix)).alias("is_prefix"),
                     F.lit(len(r.name)).alias("weight"),
                     F.array(*[F.lit(t) for t in (r.literals or ("",))]).alias("literals"))
            for i, r in enumerate(rules)]
    return spark.range(1).select(F.inline(F.array(*rows)))


def rule_index(rules: DataFrame, tokens: DataFrame) -> DataFrame:
    """One row per rule under its rarest literal token (``token``), counted over the URLs' tokens.

    A token that no URL has counts zero, so the rule is never fetched.  Ties go to the
    smaller token.
    """
    wanted = rules.select("rule_no", F.explode("literals").alias("token"))
    counts = (tokens.join(wanted.select("token").distinct(), "token", "left_semi")
              .groupBy("token").agg(F.sum("n_urls").alias("n_urls")))
    rarest = (wanted.join(counts, "token", "left")
              .groupBy("rule_no")
              .agg(F.min(F.struct(F.coalesce("n_urls", F.lit(0)).alias("n"), "token")).alias("m"))
              .select("rule_no", "m.token"))
    return rules.drop("literals").join(rarest, "rule_no")


def judge_urls(pages: DataFrame, prefix_rules: list[UrlRule], pattern_rules: list[UrlRule],
               id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Verdict of every row: page_id, host, path, rule, verdict, pattern.

    A fitting prefix rule decides, the longest one (then the greatest text) if several fit;
    else a fitting pattern rule (``pattern`` names it; the longest name, then the greatest);
    else the verdict is ``allow``.

    A verdict depends on the URL alone, so each distinct URL is judged once and joined back.
    Null URL, or one without ``://``: host and path empty, no rule, ``allow``.  Repeated rows
    are judged alike and all returned; empty tables give no rows; a rule without literals is a
    candidate for every URL.
    """
    spark = pages.sparkSession
    rules = [*prefix_rules, *pattern_rules]
    rows = first_columns(pages, page_id=id_col, _url=url_col)
    urls = rows.groupBy("_url").agg(F.count(F.lit(1)).alias("n_urls"))
    host, path = url_parts(F.col("_url"))
    urls = urls.select("_url", "n_urls", host.alias("host"), path.alias("path"))
    if not rules:
        return _with_verdict(rows, urls, None)
    every = F.array(F.lit("")) if any(not r.literals for r in rules) else F.array().cast("array<string>")
    found = F.array_distinct(F.concat(
        every, F.filter(F.split(ascii_lower(F.concat("host", "path")), _TOKEN_GAP), lambda t: t != "")))
    tokens = urls.select("_url", "n_urls", F.concat("host", "path").alias("target"),
                         F.explode(found).alias("token"))
    index = rule_index(_rule_table(spark, rules), tokens.select("token", "n_urls"))
    fits = (tokens.join(index, "token").filter("target rlike pattern")
            .groupBy("_url")
            .agg(F.max(F.struct("is_prefix", "weight", "rule", "verdict")).alias("best")))
    return _with_verdict(rows, urls, fits)


def _with_verdict(rows: DataFrame, urls: DataFrame, fits: DataFrame | None) -> DataFrame:
    host, path = url_parts(F.col("_url"))
    none = F.lit(None).cast("string")
    if fits is None:
        return rows.select("page_id", host.alias("host"), path.alias("path"), none.alias("rule"),
                           F.lit("allow").alias("verdict"), none.alias("pattern"))
    is_prefix = F.col("best.is_prefix") == 1
    return (rows.join(fits, "_url", "left")
            .select("page_id", host.alias("host"), path.alias("path"),
                    F.when(is_prefix, F.col("best.rule")).alias("rule"),
                    F.coalesce("best.verdict", F.lit("allow")).alias("verdict"),
                    F.when(~is_prefix, F.col("best.rule")).alias("pattern")))
