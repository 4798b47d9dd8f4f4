"""URL filters: written rules first, then association rules mined from labelled URLs.

FP-growth mines the combinations of URL tokens (host labels and suffixes, path
words, query keys) that go with a bad label; those with enough support and
confidence, and no smaller combination among them, become blocking rules.  The
rules stand in an inverted index, from one token of each to the whole combination:
a constant of the plan while they are few, so that judging a URL probes it once a
token, without a join or shuffle; else a table joined by token.  Everything is
DataFrame expressions and Spark's own FP-growth.

All tokens of a url are mined and judged, and rules may have any number of them.
Three things that change no verdict keep mining from counting all subsets of tokens
that go together, of which n have 2^n.  Tokens that stand in the same rows (by two
64-bit sums over them) are mined as one, and where a rule has it, any of them will do.
Tokens with less than the support among bad rows are in no rule.  Tokens that are a rule
by themselves are in no other smallest rule.

Defined results: a null url, or one without ``://``, has an empty host and path and no
tokens, and the method allows it; rows without a label are not learned from, a page
with several labels is bad if one is; without bad labels all is allowed; repeated rows
are judged each; columns other than id and url are not read.
"""

from __future__ import annotations

import itertools
import json
import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch

SUPPORT, CONFIDENCE = 0.002, 0.7
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BAD = "label=bad"
#: Bytes of rules, as JSON, that go through the driver into the plan.
RULE_BYTES = 1 << 20


def rest(url: Column) -> Column:
    """What follows the first ``://``; empty without one."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(rest(url), "^[^/?#]*", 0), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(rest(url), "^[^/?#]*([^?#]*)", 1)


def tokens(url: Column) -> Column:
    """The distinct tokens of a url: its last two host labels, other labels, path words, query keys."""
    labels = F.split(host(url), r"\.")
    suffix = F.array(F.concat(F.lit("site="), F.concat_ws(".", F.slice(F.reverse(labels), 1, 2))))
    named = F.transform(labels, lambda x: F.concat(F.lit("host="), x))
    lower = F.translate(path(url), UPPER, LOWER)
    worded = F.transform(F.filter(F.split(lower, "[^a-z]+"), lambda x: x != ""), lambda x: F.concat(F.lit("path="), x))
    query = F.regexp_extract(rest(url), r"\?([^#]*)", 1)
    keys = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("key="), F.substring_index(x, "=", 1)))
    all_ = F.array_distinct(F.concat(suffix, named, worded, keys))
    return F.when(host(url) == "", F.array().cast("array<string>")).otherwise(all_)


def learned(urls: DataFrame, labels: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """(rule) of ``urls`` (id, url) and ``labels`` (id, bad boolean), a written table: arrays of arrays, of each of which a url must have a token."""
    spark = urls.sparkSession
    marked = labels.where("bad IS NOT NULL AND id IS NOT NULL").groupBy("id").agg(F.max("bad").alias("bad"))
    known = urls.where("url IS NOT NULL").select("id", tokens(F.col("url")).alias("items")).join(marked, "id").where("size(items) > 0")
    baskets = scratch.written(known.select(F.monotonically_increasing_id().alias("row"), "items", "bad"), "baskets")
    rows = baskets.agg(F.count("*").alias("n"), F.count_if("bad").alias("bad")).first()
    least, share = math.ceil(support * rows["n"]), rows["bad"] / max(1, rows["n"])
    nothing = spark.createDataFrame([], "rule array<array<string>>")
    if not rows["bad"]:
        return nothing

    # tokens of the same rows are one; what is rare among the bad is in no rule
    each = baskets.select("row", "bad", F.explode("items").alias("token"))
    mark = lambda i: F.bit_xor(F.xxhash64("row", F.lit(i))).alias(f"mark{i}")
    cover = each.groupBy("token").agg(F.count("*").alias("n"), F.count_if("bad").alias("bad"), mark(1), mark(2)).where(F.col("bad") >= least)
    merged = cover.groupBy("n", "bad", "mark1", "mark2").agg(F.min("token").alias("token"), F.sort_array(F.collect_set("token")).alias("members"))
    merged = scratch.written(merged.select("token", "members", "n", ((F.col("bad") / F.col("n") >= confidence) & (F.col("bad") / F.col("n") > share)).alias("rule")), "tokens")
    alone = merged.where("rule").select(F.array("members").alias("rule"))

    # nothing with a token that is a rule by itself is a smallest rule
    fewer = each.join(merged.where("NOT rule").select("token"), "token").groupBy("row").agg(F.collect_set("token").alias("items"), F.max("bad").alias("bad"))
    fewer = scratch.written(fewer.select(F.when(F.col("bad"), F.concat("items", F.array(F.lit(BAD)))).otherwise(F.col("items")).alias("items")), "baskets")
    many = fewer.count()
    if not many:
        return scratch.written(alone, "rules")
    model = FPGrowth(itemsCol="items", minSupport=max(0.0, (least - 0.5) / many), minConfidence=confidence).fit(fewer)
    found = model.associationRules.where((F.element_at("consequent", 1) == BAD) & (F.col("confidence") > share))
    found = scratch.written(found.select(F.sort_array("antecedent").alias("items")), "found")
    smaller = found.select(F.col("items").alias("_in"), F.element_at("items", 1).alias("_first"))
    wider = found.select("items", F.explode("items").alias("_token")).join(smaller, (F.col("_first") == F.col("_token")) & (F.size("_in") < F.size("items")) & (F.size(F.array_except("_in", "items")) == 0))
    least_ = found.join(wider.select("items").distinct(), "items", "left_anti")
    held = least_.select("items", F.explode("items").alias("token")).join(merged, "token").groupBy("items").agg(F.sort_array(F.collect_list(F.struct("n", "members"))).alias("held"))
    return scratch.written(alone.unionByName(held.select(F.transform("held", lambda h: h["members"]).alias("rule"))), "rules")


def mine(urls: DataFrame, labels: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> list[list[str]]:
    """``learned`` token by token, for rules that are few."""
    rules = [r["rule"] for r in learned(urls, labels, support, confidence).collect()]
    return sorted((sorted(x) for rule in rules for x in itertools.product(*rule)), key=lambda x: (len(x), x))


def matched(url_tokens: Column, rules: list[list[list[str]]]) -> Column:
    """Whether, for some of ``rules``, a token of each of its arrays is among ``url_tokens``; rules stand by the tokens of their first array."""
    index: dict[str, list[list[list[str]]]] = {}
    for first, *rest in rules:
        for token in first:
            index.setdefault(token, []).append(rest)
    if not index:
        return F.lit(False)
    known = F.from_json(F.lit(json.dumps(index)), "map<string,array<array<array<string>>>>")
    fits = lambda rest: F.forall(rest, lambda members: F.arrays_overlap(members, url_tokens))
    return F.exists(url_tokens, lambda t: F.coalesce(F.exists(known[t], fits), F.lit(False)))


def marked(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``urls`` (id, url) with ``mined``: whether a rule fits.  Up to RULE_BYTES of rules are a constant of the plan, more are joined by token."""
    size = rules.agg(F.coalesce(F.sum(F.length(F.to_json("rule"))), F.lit(0))).first()[0]
    if size <= RULE_BYTES:
        return urls.withColumn("mined", matched(tokens(F.col("url")), [r["rule"] for r in rules.collect()]))
    urls = scratch.written(urls.select(F.monotonically_increasing_id().alias("row"), "id", "url"), "urls")
    index = rules.select(F.explode(F.element_at("rule", 1)).alias("token"), F.slice("rule", 2, 1 << 30).alias("rest"))
    asked = urls.select("row", tokens(F.col("url")).alias("items")).select("row", "items", F.explode("items").alias("token"))
    hit = asked.join(index, "token").where(F.forall("rest", lambda members: F.arrays_overlap(members, F.col("items")))).select("row").distinct()
    return urls.join(hit.withColumn("mined", F.lit(True)), "row", "left").select("id", "url", F.coalesce("mined", F.lit(False)).alias("mined"))


def written(host_: Column, path_: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, action) of the longest of ``rules`` (action, host, path) that fits; null where none does."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for does, name, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host_ == name) | F.endswith(host_, F.lit("." + name))) & F.startswith(path_, F.lit(start))
        rule, action = F.when(fits, F.lit(name + start)).otherwise(rule), F.when(fits, F.lit(does)).otherwise(action)
    return rule, action


def judge(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict, mined) of every row of ``pages``; ``labels`` (id, bad) are learned from."""
    urls = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    judged = marked(urls, learned(urls, labels))
    parts = judged.select("id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), "mined")
    rule, action = written(F.col("host"), F.col("path"), rules)
    return parts.select("id", "host", "path", rule.alias("rule"), F.coalesce(action, F.when(F.col("mined"), "block").otherwise("allow")).alias("verdict"), "mined")
