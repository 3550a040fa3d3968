"""Judge URLs by listed rules and by token combinations mined from labels.

Listed rules name a host and a path; the longest one that fits decides. All other URLs are judged
by association rules: frequent-pattern mining over the tokens of labelled pages finds combinations
that occur often enough (support) and are bad often enough (confidence), of any length. Only minimal
rules count, those with no other rule inside: any page a longer one fits is blocked already. So tokens
that occur on just the same labelled pages (the words of a URL template) are one class, mined as one
item and present on a page with any of them; classes that are rules alone, and those on all labelled
pages, are left out of the mining, as no longer minimal rule holds them. Combinations are matched
through an inverted index that files each one under its rarest token, so tokens that every URL has
lead to few candidates.

Defined results: a NULL URL or one without ``://`` has empty host and path, no listed rule and no
tokens of its own, so it is allowed; a page that repeats is judged each time; a page with several
label rows is bad if any of them is (NULL labels say nothing); without labels nothing is mined and
the method allows everything. Only the named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanloom.llm.common import kept

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BAD = "label=bad"
MIN_SUPPORT = 0.002
MIN_CONFIDENCE = 0.6


class Mined(NamedTuple):
    """``rules``: ``tokens, support, confidence``, a class of tokens named by its first one.
    ``members``: ``token, name``, the class of every token that occurs in a rule."""

    rules: DataFrame
    members: DataFrame


class ListedRule(NamedTuple):
    host: str
    path: str
    verdict: str


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z in lower case."""
    host = F.translate(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), UPPER, LOWER)
    return F.coalesce(host, F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def listed_rule(host: Column, path: Column, rules: Sequence[ListedRule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits; NULL where none does.

    The list is a parameter of the job, so it is an expression and needs no join.
    """
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.host + r.path), r.verdict == "block")):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        name = F.when(fits, F.lit(rule.host + rule.path)).otherwise(name)
        verdict = F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return name, verdict


def url_tokens(url: Column) -> Column:
    """Distinct tokens of a URL: its host, the host's labels, and the words of all that follows.

    Letters A-Z count as lower case, a run of digits as ``0``.
    """
    host = url_host(url)
    rest = F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*((?s:.*))$", 1), F.lit(""))
    words = F.regexp_extract_all(F.regexp_replace(F.translate(rest, UPPER, LOWER), r"[0-9]+", "0"),
                                 F.lit(r"[^/?#&=._+:;,%~!-]+"), F.lit(0))
    tagged = F.concat(F.array(F.concat(F.lit("host="), host)),
                      F.transform(F.regexp_extract_all(host, F.lit(r"[^.]+"), F.lit(0)), lambda t: F.concat(F.lit("h="), t)),
                      F.transform(words, lambda t: F.concat(F.lit("w="), t)))
    return F.coalesce(F.when(host != "", F.array_distinct(tagged)), F.array().cast("array<string>"))


def bad_pages(labels: DataFrame) -> DataFrame:
    """``page_id, bad``: of low quality or toxic by any of its label rows."""
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    known = labels.where("doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL)")
    return known.groupBy(F.col("doc_id").alias("page_id")).agg(F.max(F.coalesce(bad, F.lit(False))).alias("bad"))


def _classes(transactions: DataFrame) -> DataFrame:
    """``token, name, pages, bad``: tokens on the same labelled pages share a name.

    Compared are the distinct token lists that hold a token: their number and 128 bits.
    """
    lists = transactions.groupBy("items").agg(F.count("*").alias("pages"), F.count_if("bad").alias("bad"))
    held = (lists.select("pages", "bad", F.xxhash64("items").alias("h"), F.xxhash64(F.lit(1), "items").alias("g"),
                         F.explode("items").alias("token"))
            .groupBy("token").agg(F.sum("pages").alias("pages"), F.sum("bad").alias("bad"), F.count("*").alias("lists"),
                                  F.bit_xor("h").alias("h"), F.bit_xor("g").alias("g")))
    names = held.groupBy("lists", "h", "g").agg(F.min("token").alias("name"))
    return held.join(names, ["lists", "h", "g"]).select("token", "name", "pages", "bad")


def mined_rules(pages: DataFrame, labels: DataFrame, *, min_support: float = MIN_SUPPORT,
                min_confidence: float = MIN_CONFIDENCE) -> Mined:
    """Minimal token combinations that speak against a page.

    ``support`` is the share of labelled pages that have the combination and are bad. The number
    of rules depends on the thresholds, not on the number of pages.
    """
    transactions = kept(pages.where("page_id IS NOT NULL")
                        .select("page_id", F.array_sort(url_tokens(F.col("url"))).alias("items"))
                        .join(bad_pages(labels), "page_id")
                        .select(F.monotonically_increasing_id().alias("id"), "items", "bad"), "url-labelled")
    total = transactions.count()
    often = F.col("bad") >= max(1, math.ceil(min_support * total))
    classes = kept(_classes(transactions).where(often).withColumn("confidence", F.col("bad") / F.col("pages")), "url-classes")
    alone = (classes.where(F.col("confidence") >= min_confidence)
             .select(F.array("name").alias("tokens"), (F.col("bad") / F.lit(float(max(1, total)))).alias("support"), "confidence").distinct())
    joined = classes.where((F.col("confidence") < min_confidence) & (F.col("pages") < total)).select("token", "name")
    items = (transactions.select("id", "bad", F.explode_outer("items").alias("token")).join(joined, "token", "left")
             .groupBy("id").agg(F.collect_set("name").alias("items"), F.max("bad").alias("bad"))
             .select(F.when(F.col("bad"), F.concat("items", F.array(F.lit(BAD)))).otherwise(F.col("items")).alias("items")))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(items)
    longer = kept(model.associationRules.where(F.col("consequent") == F.array(F.lit(BAD)))
                  .select(F.array_sort("antecedent").alias("tokens"), "support", "confidence"), "url-rules")
    rules = kept(alone.union(_minimal(longer)), "url-minimal")
    used = rules.select(F.explode("tokens").alias("name")).distinct()
    return Mined(rules, classes.select("token", "name").join(used, "name", "left_semi"))


def _filed(rules: DataFrame, uses: DataFrame) -> DataFrame:
    """``tokens, confidence, token`` of every rule: the token of the fewest ``uses`` stands for it."""
    spread = rules.select("tokens", "confidence", F.explode("tokens").alias("token"))
    return (spread.join(uses, "token").groupBy("tokens", "confidence")
            .agg(F.min(F.struct("uses", "token")).getField("token").alias("token")))


def _minimal(rules: DataFrame) -> DataFrame:
    """All rules but those with another rule inside."""
    spread = rules.select(F.col("tokens").alias("_long"), F.explode("tokens").alias("token"))
    index = _filed(rules, spread.groupBy("token").agg(F.count("*").alias("uses")))
    redundant = (spread.join(index, "token")
                 .where((F.size("tokens") < F.size("_long")) & (F.size(F.array_except("tokens", "_long")) == 0))
                 .select("_long").distinct())
    return rules.join(redundant, F.col("tokens") == F.col("_long"), "left_anti")


def match_rules(pages: DataFrame, mined: Mined) -> DataFrame:
    """Pages that some combination fits: ``url, n_rules, confidence`` (the highest).

    ``n_rules`` counts minimal rules; those that differ only within classes of tokens are one.
    """
    urls = pages.select("url").distinct().where("url IS NOT NULL")
    owned = (urls.select("url", F.explode(url_tokens(F.col("url"))).alias("token")).join(mined.members, "token")
             .groupBy("url").agg(F.collect_set("name").alias("items")))
    listed = owned.select("url", "items", F.explode("items").alias("token"))
    index = _filed(mined.rules, listed.groupBy("token").agg(F.count("*").alias("uses")))
    found = listed.join(index, "token").where(F.size(F.array_except("tokens", "items")) == 0)
    return found.groupBy("url").agg(F.count("*").alias("n_rules"), F.max("confidence").alias("confidence"))


def judge_urls(pages: DataFrame, labels: DataFrame, listed: Sequence[ListedRule], *, min_support: float = MIN_SUPPORT,
               min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """``page_id, url, host, path, rule, verdict, n_rules, confidence`` for every row of ``pages``."""
    rules = mined_rules(pages, labels, min_support=min_support, min_confidence=min_confidence)
    matched = match_rules(pages, rules).withColumnRenamed("url", "_url")
    host, path = url_host(F.col("url")), url_path(F.col("url"))
    name, verdict = listed_rule(F.col("host"), F.col("path"), listed)
    judged = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    mined = F.when(F.col("n_rules") > 0, F.lit("block")).otherwise(F.lit("allow"))
    return (judged.join(matched, judged["url"] == matched["_url"], "left")
            .select("page_id", "url", "host", "path", name.alias("rule"), F.coalesce(verdict, mined).alias("verdict"),
                    F.coalesce("n_rules", F.lit(0)).alias("n_rules"), "confidence"))


SQL = r"""
WITH parsed AS (
  SELECT page_id, url,
         coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path,
         coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*((?s:.*))$', 1), '') AS rest
  FROM pages),
tokens AS (
  SELECT page_id, url, unnest(list_distinct(list_concat(
           ['host=' || host],
           list_transform(regexp_extract_all(host, '[^.]+'), lambda t: 'h=' || t),
           list_transform(regexp_extract_all(regexp_replace(translate(rest, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[0-9]+', '0', 'g'), '[^/?#&=._+:;,%~!-]+'), lambda t: 'w=' || t)))) AS token
  FROM parsed WHERE host <> ''),
bad AS (
  SELECT doc_id AS page_id, bool_or(coalesce(quality = 0 OR toxic = 1, false)) AS bad FROM labels
  WHERE doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL) GROUP BY doc_id),
known AS (SELECT p.page_id, p.url, b.bad FROM (SELECT DISTINCT page_id, url FROM pages) p JOIN bad b USING (page_id)),
seen AS (SELECT t.page_id, t.url, t.token, k.bad FROM tokens t JOIN known k ON t.page_id = k.page_id AND t.url = k.url),
size AS (SELECT ceil(0.002 * (SELECT count(*) FROM pages JOIN bad USING (page_id))) AS least),
class AS (
  SELECT token, min(token) OVER (PARTITION BY places) AS item
  FROM (SELECT token, list({'page': page_id, 'url': url} ORDER BY page_id, url) AS places FROM seen GROUP BY token)),
held AS (SELECT DISTINCT page_id, url, item, bad FROM seen JOIN class USING (token)),
sets AS (
  SELECT [item] AS items, bad FROM held
  UNION ALL
  SELECT [a.item, b.item], a.bad FROM held a JOIN held b ON a.page_id = b.page_id AND a.url = b.url AND a.item < b.item
  UNION ALL
  SELECT [a.item, b.item, c.item], a.bad FROM held a
  JOIN held b ON a.page_id = b.page_id AND a.url = b.url AND a.item < b.item
  JOIN held c ON a.page_id = c.page_id AND a.url = c.url AND b.item < c.item),
all_rules AS (
  SELECT items, count(*) FILTER (WHERE bad)::DOUBLE / count(*)::DOUBLE AS confidence FROM sets GROUP BY items
  HAVING count(*) FILTER (WHERE bad) >= (SELECT least FROM size) AND count(*) FILTER (WHERE bad) > 0
     AND count(*) FILTER (WHERE bad)::DOUBLE / count(*)::DOUBLE >= 0.6),
inner_sets AS (
  SELECT items, unnest([[items[1]], [items[2]], [items[3]], [items[1], items[2]], [items[1], items[3]], [items[2], items[3]]]) AS part
  FROM all_rules WHERE len(items) > 1),
rules AS (
  SELECT * FROM all_rules WHERE items NOT IN (
    SELECT i.items FROM inner_sets i JOIN all_rules r ON i.part = r.items WHERE i.part <> i.items)),
urls AS (SELECT url, list(DISTINCT item) AS owned FROM tokens JOIN class USING (token) GROUP BY url),
matched AS (
  SELECT u.url, count(*) AS n_rules, max(r.confidence) AS confidence
  FROM urls u JOIN rules r ON list_contains(u.owned, r.items[1]) AND list_has_all(u.owned, r.items) GROUP BY u.url),
listed AS (
  SELECT * FROM (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
                        ('net', '/es/', 'block'), ('net', '/fr/', 'block')) AS l(rule_host, rule_path, says)),
best AS (
  SELECT p.host, p.path, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
         arg_max(says, length(rule_host || rule_path)) AS says
  FROM (SELECT DISTINCT host, path FROM parsed) p
  JOIN listed ON (p.host = rule_host OR ends_with(p.host, '.' || rule_host)) AND starts_with(p.path, rule_path)
  GROUP BY p.host, p.path)
SELECT p.page_id, p.host, p.path, b.rule,
       coalesce(b.says, CASE WHEN m.n_rules > 0 THEN 'block' ELSE 'allow' END) AS verdict,
       coalesce(m.n_rules, 0)::BIGINT AS n_rules, m.confidence
FROM parsed p LEFT JOIN best b ON p.host = b.host AND p.path = b.path LEFT JOIN matched m ON p.url = m.url
"""
