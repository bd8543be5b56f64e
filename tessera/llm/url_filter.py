"""URL filters: pattern rules found by their rarest literal token.

A rule is a regular expression on host and path, with the literal tokens (host labels, path
segments) that every URL it matches contains. It is indexed by the one of them that the
fewest URLs of the table have. A URL's tokens fetch the rules they index, and only those
rules' expressions run. All of it is column expressions: the index is an array of buckets
that a token's hash selects from, so fetching costs the same for any number of rules.
"""

from __future__ import annotations

import json
import re
import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: With more rules than this, the index is a table to join with instead of part of the plan.
MOST_INLINE_RULES = 4_096


@dataclass(frozen=True)
class Rule:
    action: str  # allow or block
    expression: str
    tokens: tuple[str, ...]
    name: str
    #: Site rules decide before pattern rules, among each other the longest name does.
    site: bool = True


def site_rule(action: str, name: str) -> Rule:
    """A host with its subdomains, and the start of a path."""
    host, slash, path = name.partition("/")
    segments = path.split("/")[:-1]  # the last may go on in the URL
    expression = rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(slash + path)}"
    return Rule(action, expression, tuple(t for t in [*host.split("."), *segments] if t), name)


def pattern_rule(action: str, expression: str, *tokens: str) -> Rule:
    return Rule(action, expression, tokens, expression, site=False)


# The site rules, then patterns for what they leave open.
RULES = (
    site_rule("allow", "com/"),
    site_rule("block", "example.com/en/"),
    site_rule("allow", "www.example.com/en/"),
    site_rule("block", "net/es/"),
    site_rule("block", "net/fr/"),
    pattern_rule("block", r"/ads/", "ads"),
    pattern_rule("block", r"/advert/", "advert"),
    pattern_rule("block", r"/login(/|$)", "login"),
    pattern_rule("block", r"/signin(/|$)", "signin"),
    pattern_rule("block", r"^(?:[^/]*\.)?casino\.", "casino"),
    pattern_rule("block", r"^(?:[^/]*\.)?tracker\.", "tracker"),
    pattern_rule("block", r"^m\.[^/]*\.org/", "org"),
)


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(place: Column) -> Column:
    return F.array_distinct(F.split(place, r"[./]"))


def frequencies(places: DataFrame, tokens: list[str]) -> dict[str, int]:
    """In how many URLs of the table each of the rules' tokens stands. One number a token
    goes to the driver."""
    words = places.select(F.explode(tokens_of(F.col("_place"))).alias("token")).where(F.col("token").isin(tokens))
    return {t: 0 for t in tokens} | {r.token: r.n for r in words.groupBy("token").agg(F.count("*").alias("n")).collect()}


def judge(pages: DataFrame, keep: list[str], url: str = "url", rules: tuple[Rule, ...] = RULES, default: str = "allow") -> DataFrame:
    """``keep``, host, path, rule and verdict for each row. Null urls and urls without
    ``://`` have an empty host and path and get the default, as do urls that no rule
    matches. Rows that repeat stay; the table is never shuffled unless there are more than
    ``MOST_INLINE_RULES`` rules."""
    placed = pages.select(*keep, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    placed = placed.withColumn("_place", F.concat("host", "path"))
    if len(rules) > MOST_INLINE_RULES:
        return judged_by_join(placed, keep, rules, default)
    tokens = sorted({t for r in rules for t in r.tokens})
    count = frequencies(placed, tokens)
    n = 1 << max(4, len(rules).bit_length())
    buckets: list[list[dict]] = [[] for _ in range(n)]
    for r in rules:
        rarest = min(r.tokens, key=lambda t: (count[t], t))
        buckets[zlib.crc32(rarest.encode()) % n].append({"token": rarest, "rank": rank(r), "name": r.name, "action": r.action, "site": r.site, "expression": r.expression})
    kind = "array<array<struct<token:string,rank:int,name:string,action:string,site:boolean,expression:string>>>"
    index = F.from_json(F.lit(json.dumps(buckets)), kind)
    place = F.col("_place")
    fetched = F.flatten(F.transform(tokens_of(place), lambda t: F.filter(F.get(index, (F.crc32(t) % n).cast("int")), lambda r: r["token"] == t)))
    fitting = F.filter(fetched, lambda r: F.rlike(place, r["expression"]))
    best = F.array_max(F.transform(fitting, lambda r: F.struct(r["site"].alias("site"), r["rank"].alias("rank"), r["name"].alias("name"), r["action"].alias("action"))))
    return placed.withColumn("_best", best).select(*keep, "host", "path", *verdict(F.col("_best"), default))


def rank(r: Rule) -> int:
    return len(r.name)


def verdict(best: Column, default: str) -> list[Column]:
    return [F.when(best["site"], best["name"]).alias("rule"), F.coalesce(best["action"], F.lit(default)).alias("verdict")]


def judged_by_join(placed: DataFrame, keep: list[str], rules: tuple[Rule, ...], default: str) -> DataFrame:
    """The same with the rules as a table, joined on the token. Places are judged once
    each, so a place that holds a third of all rows is one row here."""
    spark = placed.sparkSession
    table = spark.createDataFrame(
        [(i, t, r.site, rank(r), r.name, r.action, r.expression) for i, r in enumerate(rules) for t in set(r.tokens)],
        "id long, token string, site boolean, rank int, name string, action string, expression string",
    )
    places = placed.select("_place").distinct()
    words = places.select("_place", F.explode(tokens_of(F.col("_place"))).alias("token"))
    counted = table.join(words.groupBy("token").agg(F.count("*").alias("_n")), "token", "left")
    rarest = counted.groupBy("id").agg(F.min_by(F.struct(*table.columns), F.struct(F.coalesce("_n", F.lit(0)), "token")).alias("_r")).select("_r.*")
    best = F.max(F.struct("site", "rank", "name", "action")).alias("_best")
    judged = words.join(rarest, "token").where(F.rlike("_place", F.col("expression"))).groupBy("_place").agg(best)
    return placed.join(judged, "_place", "left").select(*keep, "host", "path", *verdict(F.col("_best"), default))


SQL = r"""
WITH placed AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '^(?:.|\n)*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '^(?:.|\n)*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), rules(name, action) AS (
  VALUES ('com/', 'allow'), ('example.com/en/', 'block'), ('www.example.com/en/', 'allow'), ('net/es/', 'block'), ('net/fr/', 'block')
), judged AS (
  SELECT p.page_id, host, path,
         (SELECT arg_max(name, length(name)) FROM rules
          WHERE (host = split_part(name, '/', 1) OR ends_with(host, '.' || split_part(name, '/', 1)))
            AND starts_with(path, substr(name, strpos(name, '/')))) AS rule
  FROM placed p
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IS NOT NULL THEN (SELECT action FROM rules WHERE name = rule)
            WHEN regexp_matches(host || path, '/(ads|advert)/|/(login|signin)(/|$)') THEN 'block'
            WHEN regexp_matches(host || path, '^([^/]*\.)?(casino|tracker)\.') THEN 'block'
            WHEN regexp_matches(host || path, '^m\.[^/]*\.org/') THEN 'block'
            ELSE 'allow' END AS verdict
FROM judged
"""
