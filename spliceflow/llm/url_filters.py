"""URL filters: pattern rules indexed by their rarest literal token; a URL's tokens fetch the few rules that are run.

A rule is `host/path`. The host fits itself and all its subdomains (an empty one fits any host), the path is a prefix
of the URL's path, and without a slash the rule takes any path. `*` stands for any characters: within the host, or, in
the path, anywhere up to the URL's `?` or `#`. Each rule becomes one regular expression and is filed under one literal
token, that of its whole tokens which the fewest URLs hold. URLs look their own tokens up, and a regular expression runs
only on URLs that hold its rule's token. Rules without a whole token (`*casino*`) are filed under the empty token, which
each URL holds: they are tried on all of them.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, joined_with_hot_keys, written
from .decontamination import lowered

#: The base rules of the contract, as (verdict, rule).
BASE_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
#: Rules of our own, asked where no base rule fits: advertising, gambling, pills, adult pages, link farms, and pages that
#: hold no prose. A word before a joining sign is a whole token, so most of these are looked up and not tried on all URLs.
OWN_RULES = [
    ("block", "casino-*/"), ("block", "*-casino.*/"), ("block", "ads-*/"), ("block", "*-ads.*/"), ("block", "free-bets*/"), ("block", "*-bets.*/"), ("block", "spam-*/"),
    ("block", "*-farm.*/"), ("block", "cheap-pills*/"), ("block", "*-pills.*/"), ("block", "adult*/"), ("block", "doubleclick.net/"), ("block", "/wp-login.php"),
    ("block", "/wp-admin/"), ("block", "/cgi-bin/"), ("block", "/*/feed/"), ("allow", "wikipedia.org/wiki/"), ("allow", "docs.*/"),
]

#: The index is broadcast up to so many rules and bytes. Beyond, URLs and rules meet by token in a shuffle, and tokens
#: that more than HOT URLs hold are met apart (see joined_with_hot_keys).
MAX_RULES, MAX_BYTES, HOT = 500_000, 64 << 20, 100_000
TOKEN = r"[\p{Alnum}\P{ASCII}]"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host after the first `://`, A-Z lower-cased, and the path up to `?` or `#`. Null, or none: both empty."""
    rest = lambda i: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", i), F.lit(""))
    return lowered(rest(1)), rest(2)


def tokens(address: Column) -> Column:
    """The distinct tokens of host and path together: runs of letters, digits and all beyond ASCII."""
    return F.array_distinct(F.regexp_extract_all(address, F.lit(f"{TOKEN}++"), F.lit(0)))


def compiled(rules: DataFrame) -> DataFrame:
    """rules(verdict, rule, tier): one row per rule, with its regular expression and its literals, the whole tokens.

    Literals are tokens that each fitting URL holds as tokens of its own: what touches a `*` isn't whole, nor is the end
    of a path, which is a prefix. A rule that is null or empty, or whose verdict isn't allow or block, is left out; of a
    rule that is listed with both verdicts in one tier, allow holds.
    """
    rules = rules.where(F.col("verdict").isin("allow", "block") & (F.col("rule") != "")).groupBy("tier", "rule").agg(F.min("verdict").alias("verdict"))
    slash = F.instr("rule", "/")
    host = lowered(F.when(slash > 0, F.expr("substr(rule, 1, instr(rule, '/') - 1)")).otherwise(F.col("rule")))
    path = F.when(slash > 0, F.expr("substr(rule, instr(rule, '/'))")).otherwise(F.lit(""))
    quoted = lambda c: F.concat(F.lit(r"\Q"), F.replace(c, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    # after a star the first place of the next literal is as good as any other, so atomic groups keep matching linear; only
    # the last literal of a host stands at its end
    later = lambda of, any_: F.array_join(F.transform(of, lambda x: F.concat(F.lit(f"(?>{any_}*?"), quoted(x), F.lit(")"))), "")
    h, p = F.split(host, r"\*"), F.split(path, r"\*")
    first = F.when(F.get(h, F.lit(0)) == "", F.lit("")).otherwise(F.concat(F.lit(r"(?>(?:[^/]*?\.)??"), quoted(F.get(h, F.lit(0))), F.lit(")")))
    starred = F.concat(F.lit("^"), first, later(F.slice(h, 2, F.greatest(F.size(h) - 2, F.lit(0))), "[^/]"), F.lit("[^/]*"), quoted(F.element_at(h, -1)))
    start = F.when(host == "", F.lit("^[^/]*+")).when(F.size(h) > 1, starred).otherwise(F.concat(F.lit(r"^(?:[^/]*\.)?"), quoted(host)))
    end = F.when(slash > 0, F.concat(quoted(F.get(p, F.lit(0))), later(F.slice(p, 2, F.size(p)), "."))).otherwise(F.lit("(?![^/])"))
    literal = F.concat(host, F.when(slash > 0, F.concat(path, F.lit("*"))).otherwise(path))
    return rules.select(
        "tier", "rule", "verdict", F.concat(F.lit("(?s)"), start, end).alias("regex"),
        F.array_distinct(F.regexp_extract_all(literal, F.lit(rf"(?<![*\p{{Alnum}}\P{{ASCII}}]){TOKEN}++(?!\*)"), F.lit(0))).alias("literals"),
    )


def _addresses(rows: DataFrame) -> DataFrame:
    """The distinct addresses and their places, the number of rows that have them."""
    return written(rows.groupBy("address").agg(F.count("*").alias("places")))


def index(rules: DataFrame, addresses: DataFrame) -> DataFrame:
    """The compiled rules, each with token (its literal that the fewest addresses hold) and places (so many addresses).

    Ties go to the longer token, then to the smaller one. Only tokens that a rule names are counted. A rule without
    literals has the empty token, and more places than any other.
    """
    rules = written(compiled(rules))
    named = rules.select(F.explode("literals").alias("token")).distinct()
    held = addresses.select(F.explode(tokens(F.col("address"))).alias("token")).join(named, "token", "left_semi")
    counts = held.groupBy("token").agg(F.count("*").alias("places"))
    each = rules.select("tier", "rule", F.explode("literals").alias("token")).join(counts, "token", "left")
    each = each.select("tier", "rule", F.struct(F.coalesce("places", F.lit(0)).alias("places"), (-F.length("token")).alias("n"), "token").alias("t"))
    rarest = each.groupBy("tier", "rule").agg(F.min("t").alias("t"))
    token, places = F.coalesce(F.col("t")["token"], F.lit("")), F.coalesce(F.col("t")["places"], F.lit(1 << 62).cast("long"))
    out = written(rules.join(rarest, ["tier", "rule"], "left").select("tier", "rule", "verdict", "regex", token.alias("token"), places.alias("places")))
    discard(rules)
    return out


def verdicts(addresses: DataFrame, rules: DataFrame) -> DataFrame:
    """addresses(address, places) with `best`, the winning rule as struct(tier, n, allow, rule), or null where none fits."""
    table = index(rules, addresses)
    size = table.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length("rule") + F.octet_length("regex") + F.octet_length("token") + 64), F.lit(0)).alias("bytes")).first()
    best = F.max(F.when(F.expr("address rlike regex"), F.struct("tier", F.length("rule").alias("n"), (F.col("verdict") == "allow").alias("allow"), "rule"))).alias("best")
    looked = addresses.select("address", "places", F.explode(F.array_append(tokens(F.col("address")), F.lit(""))).alias("token"))
    if size["rows"] <= MAX_RULES and size["bytes"] <= MAX_BYTES:
        return looked.join(F.broadcast(table.drop("places")), "token", "left").groupBy("address", "places").agg(best)
    # the empty token and other common ones are hot keys there
    met = joined_with_hot_keys(looked.select("address", "token"), table, "token", F.xxhash64("address"), HOT)
    return addresses.join(met.groupBy("address").agg(best), "address", "left")


def judged(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """pages and `judgement`: struct(host, path, tier, rule, verdict).

    rules(verdict, rule, tier): a larger tier goes first; within it the longer rule wins, then allow over block, then the
    larger text. Where none fits, tier and rule are null and the verdict is `default`. A null URL, or one without `://`,
    has an empty host and path, and is judged on these. Equal URLs are judged once and each row gets its result, so ids
    may be null and rows may repeat; an address that more than HOT rows have is met by broadcast or in salted tasks.
    Other columns stay whatever their names, but for a column `judgement`, which is replaced. Time grows with a URL's
    length in proportion. Without pages: no rows; without rules: `default`.
    """
    host, path = host_and_path(F.col(url))
    rows = pages.select(F.struct(*[c for c in pages.columns if c != "judgement"]).alias("row"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("address", F.concat("host", "path"))
    found = written(verdicts(_addresses(rows.select("address")), rules))
    met = joined_with_hot_keys(rows, found, "address", F.xxhash64("row"), HOT)
    verdict = F.when(F.col("best").isNull(), F.lit(default)).when(F.col("best")["allow"], F.lit("allow")).otherwise(F.lit("block"))
    return met.select("row.*", F.struct("host", "path", F.col("best")["tier"].alias("tier"), F.col("best")["rule"].alias("rule"), verdict.alias("verdict")).alias("judgement"))


def url_report(pages: DataFrame) -> DataFrame:
    """One row per page: host, path, the base rule that fits (or null), the verdict, and the rule of our own where that decides.

    Our own rules are asked only where no base rule fits, and what no rule fits is allowed. Edge cases: see judged.
    """
    listed = [(v, r, 1) for v, r in BASE_RULES] + [(v, r, 0) for v, r in OWN_RULES]
    rules = pages.sparkSession.createDataFrame(listed, "verdict string, rule string, tier int")
    j, rule = F.col("judgement"), F.col("judgement")["rule"]
    base = j["tier"] == 1
    return judged(pages.select("page_id", "url"), rules).select("page_id", j["host"].alias("host"), j["path"].alias("path"), F.when(base, rule).alias("rule"), j["verdict"].alias("verdict"), F.when(~base, rule).alias("own_rule"))


def _sql_pattern(rule: str) -> str:
    """A rule as a regular expression of DuckDB's, over host and path together."""
    host, slash, path = rule.partition("/")
    text = ("^[^/]*" if not host else r"^([^/]*\.)?" + re.escape(host).replace(r"\*", "[^/]*")) + (re.escape("/" + path).replace(r"\*", ".*") if slash else "(/|$)")
    return "'(?s)" + text.replace("'", "''") + "'"


def _sql() -> str:
    def first(rules: list[tuple[str, str]], what: int) -> str:
        order = sorted(rules, key=lambda r: (len(r[1]), r[0] == "allow", r[1]), reverse=True)
        return "CASE " + " ".join(f"WHEN regexp_matches(host || path, {_sql_pattern(r[1])}) THEN '{r[what]}'" for r in order) + " END"

    return f"""
WITH parts AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
fits AS (
  SELECT *, {first(BASE_RULES, 1)} AS rule, {first(BASE_RULES, 0)} AS base, {first(OWN_RULES, 1)} AS own, {first(OWN_RULES, 0)} AS other
  FROM parts)
SELECT page_id, host, path, rule, coalesce(base, other, 'allow') AS verdict, CASE WHEN rule IS NULL THEN own END AS own_rule FROM fits"""


ORACLE_SQL = _sql()
