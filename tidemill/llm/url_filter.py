"""URL filtering: given rules first, mined association rules for the rest. DataFrame functions only.

FP-growth mines combinations of URL tokens and labels; rules from tokens to a label are pruned by confidence, support
and redundancy. Pages that a given rule decides are the labels. The tokens that any given rule names are no evidence, for
either label: otherwise mining would hand the given rules' own words back, wider than they were meant. An inverted index holds each mined rule under its rarest token and finds the rules whose tokens a URL all has.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm import scratch

MIN_SUPPORT = 0.002
MIN_CONFIDENCE = 0.9
MAX_TOKENS = 3  # tokens of a mined rule
DEFAULT = "allow"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _after(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or no ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(_after(url), "^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(_after(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def query_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after(url), r"^[^?#]*\?([^#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Struct (rule, verdict) of the longest of ``rules`` (verdict, host, path) that fits; null if none does."""
    best = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        best = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(best)
    return best


def _named(prefix: str, parts: Column) -> Column:
    shape = lambda x: F.concat(F.lit(prefix), F.regexp_replace(x, "[0-9]+", "#"))
    return F.transform(F.filter(parts, lambda x: x != ""), shape)


def tokens(url: Column) -> Column:
    """Host labels, path segments and query names of a URL, digits folded, each once."""
    host, path = F.split(host_of(url), r"\."), F.split(path_of(url), "/")
    names = F.transform(F.split(query_of(url), "&"), lambda x: F.regexp_extract(x, "^[^=]*", 0))
    kinds = [_named("host:", host), _named("path:", path), _named("query:", names)]
    return F.array_distinct(F.concat(*kinds))


def named_tokens(rules: list[tuple[str, str, str]]) -> Column:
    """The tokens that the given rules name, each once."""
    return F.array_distinct(F.concat(F.array().cast("array<string>"), *(tokens(F.lit(f"://{h}{p}")) for _, h, p in rules)))


def mine_rules(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """(rule_id, tokens, label, confidence, support, rarest) from ``labelled`` (url, label and, if given, own: tokens that are no evidence).

    Rows with a null url or label teach nothing. A rule goes if another for the same label with some of its tokens is
    at least as confident. ``rarest`` is its token that the fewest labelled URLs have.
    """
    spark = labelled.sparkSession
    shape = "rule_id long, tokens array<string>, label string, confidence double, support double, rarest string"
    own = F.coalesce("own", F.array().cast("array<string>")) if "own" in labelled.columns else F.array().cast("array<string>")
    known = labelled.where("url IS NOT NULL AND label IS NOT NULL").select(F.array_except(tokens(F.col("url")), own).alias("items"), F.concat(F.lit("label="), F.col("label")).alias("label"))
    known = scratch.materialize(known.withColumn("row", F.monotonically_increasing_id()), "labelled")
    count = known.count()
    if not count:
        return spark.createDataFrame([], shape)
    # A token below the support stands in no rule: without it transactions are small and lose nothing.
    each = known.select("row", F.explode("items").alias("token"))
    common = scratch.materialize(each.groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= math.ceil(min_support * count)).select("token", "n"), "common")
    seen = scratch.materialize(each.join(common.select("token"), "token").groupBy("row").agg(F.collect_list("token").alias("items")), "transactions")
    left = known.select("row", "label").join(seen.hint("merge"), "row", "left")
    data = left.select(F.array_append(F.coalesce("items", F.array().cast("array<string>")), F.col("label")).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(data)
    label = F.col("consequent")[0]
    rules = model.associationRules.where(label.startswith("label=") & (F.size("antecedent") <= max_tokens)).where(~F.exists("antecedent", lambda x: x.startswith("label=")))
    rules = rules.select(F.sort_array("antecedent").alias("tokens"), F.substring(label, 7, 1_000_000).alias("label"), "confidence", "support")
    rules = scratch.materialize(rules.withColumn("rule_id", F.xxhash64("tokens", "label")), "rules")
    wide = rules.select("rule_id", "label", F.col("tokens").alias("all"), F.col("confidence").alias("c"), F.explode("tokens").alias("token"))
    narrow = rules.select(F.col("rule_id").alias("other"), F.col("label").alias("label2"), "tokens", "confidence", F.explode("tokens").alias("token2"))
    worse = wide.join(narrow, (wide.token == narrow.token2) & (wide.label == narrow.label2) & (F.size("tokens") < F.size("all")) & (narrow.confidence >= wide.c))
    worse = worse.where(F.size(F.array_except("tokens", "all")) == 0).select("rule_id").distinct()
    rare = rules.select("rule_id", F.explode("tokens").alias("token")).join(common, "token").groupBy("rule_id").agg(F.min(F.struct("n", "token"))["token"].alias("rarest"))
    return scratch.materialize(rules.join(worse, "rule_id", "left_anti").join(rare, "rule_id").select("rule_id", "tokens", "label", "confidence", "support", "rarest"), "pruned")


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, label) for each distinct url of ``urls`` that some rule fits: the most confident, then longest, then best supported, then first label."""
    index = rules.select("label", "confidence", "support", F.size("tokens").alias("need"), "tokens", F.col("rarest").alias("token"))
    asked = urls.select("url").where("url IS NOT NULL").distinct().withColumn("all", tokens(F.col("url")))
    hits = asked.withColumn("token", F.explode("all")).join(index, "token").where(F.size(F.array_except("tokens", "all")) == 0)
    rank = F.struct("confidence", "need", "support", F.col("label"))
    return hits.groupBy("url").agg(F.max(rank).alias("best")).select("url", F.col("best.label").alias("label"))


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]], **mining: float) -> DataFrame:
    """page_id, host, path, rule and verdict for every row of ``pages`` (page_id, url).

    Pages that a given rule fits take its verdict and are the labels that mining learns from; the others take the label
    of the best mined rule, or ``allow`` where none fits. Null urls have an empty host and path. Repeated rows give
    repeated results; an empty table gives no rows; other columns are ignored.
    """
    url = F.col("url")
    base = pages.select("page_id", F.col("url").cast("string").alias("url")).withColumns({"host": host_of(url), "path": path_of(url)})
    judged = base.withColumn("given", longest_rule(F.col("host"), F.col("path"), rules))
    mined = mine_rules(judged.where("given IS NOT NULL").select("url", F.col("given.verdict").alias("label"), named_tokens(rules).alias("own")), **mining)
    found = scratch.materialize(match_rules(judged.where("given IS NULL"), mined), "verdicts")
    open_, done = judged.where("given IS NULL"), judged.where("given IS NOT NULL")
    verdict = open_.join(found.hint("merge"), "url", "left").select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.coalesce("label", F.lit(DEFAULT)).alias("verdict"))
    return done.select("page_id", "host", "path", F.col("given.rule").alias("rule"), F.col("given.verdict").alias("verdict")).unionByName(verdict)


def held_out_precision(pages: DataFrame, rules: list[tuple[str, str, str]], folds: int = 5, **mining: float) -> DataFrame:
    """(label, judged, right, pages): how mined rules do on pages whose verdict is known but whose hosts they have not seen.

    One fold of the decided pages' hosts is held out; rules are mined on the others. ``pages`` counts the held-out pages
    of each verdict, ``judged`` those that some mined rule gives a verdict, ``right`` those that get their own.
    """
    url = F.col("url")
    base = pages.select(F.col("url").cast("string").alias("url")).withColumn("host", host_of(url)).withColumn("given", longest_rule(F.col("host"), path_of(url), rules)).where("given IS NOT NULL")
    held = F.pmod(F.xxhash64("host"), F.lit(folds)) == 0
    mined = mine_rules(base.where(~held).select("url", F.col("given.verdict").alias("label"), named_tokens(rules).alias("own")), **mining)
    asked = base.where(held).select("url", F.col("given.verdict").alias("label"))
    found = match_rules(asked, mined).select("url", F.col("label").alias("said"))
    return asked.join(found, "url", "left").groupBy("label").agg(F.count("said").alias("judged"), F.count(F.when(F.col("said") == F.col("label"), 1)).alias("right"), F.count("*").alias("pages"))
