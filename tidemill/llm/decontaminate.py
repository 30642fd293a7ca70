"""Benchmark decontamination: short test items inside long documents. DataFrame functions only.

Size-partitioned MinHash containment search. An item with q distinct shingles is contained to the share t only if at
most q - ceil(t q) of them are missing, so of its m = q - ceil(t q) + 1 smallest hashes, its bottom-m MinHash sketch,
at least one is in the document. Items are partitioned by shingle length and by q, which sets m; the largest sketch hash
of a partition is its bound. A document is asked in every partition, with its shingle hashes up to that bound only: the
larger m is against the range, the less a bound prunes, and with m = 1 it prunes nothing, so what is left also has to
pass a bitmap of all partitions' sketches before it is joined on (partition, hash). Documents and items that meet are
verified by exact containment of the shingles' words. Long documents need no sketch of their own, so their length costs
no recall.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm import scratch

SHINGLE_WORDS = 5
CONTAINMENT = 0.8


def words_of(text: Column) -> Column:
    """Lower-cased words between ASCII white space."""
    return F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _windows(words: str, n: int, make) -> Column:
    """``make`` of every n consecutive words of the array column ``words``; an empty array if there are fewer."""
    w, count = F.col(words), F.size(words)
    at = lambda i: make([F.get(w, i + k) for k in range(n)])
    return F.when(count >= n, F.transform(F.sequence(F.lit(0), count - n), at)).otherwise(F.array().cast("array<" + ("bigint" if make is _hash else "string") + ">"))


def _hash(parts: list[Column]) -> Column:
    return F.xxhash64(*parts)


def _text(parts: list[Column]) -> Column:
    return F.concat_ws(" ", *parts)


def _up_to(hashes: Column, top: int) -> Column:
    return F.filter(hashes, lambda h: h <= F.lit(top))


def _item_shingles(make, n: int) -> Column:
    """An item's distinct shingles; one with fewer words is one shingle of all of them."""
    short = F.lit(None)
    for k in range(1, n):
        short = F.when(F.size("words") == k, _windows("words", k, make)).otherwise(short)
    return F.array_distinct(F.when(F.size("words") >= n, _windows("words", n, make)).otherwise(short))


def item_sketches(items: DataFrame, words: int = SHINGLE_WORDS, containment: float = CONTAINMENT) -> DataFrame:
    """(item_id, n, q, least, part, sketch, shingles) of every item with words: ``part`` is its partition, by shingle length n and size class of q."""
    least = F.ceil(F.col("q") * F.lit(containment) - 1e-9).cast("int")
    held = items.select(F.col("item_id"), words_of(F.col("text").cast("string")).alias("words")).where("size(words) > 0").distinct()
    held = held.withColumns({"n": F.least(F.size("words"), F.lit(words)), "hashes": _item_shingles(_hash, words), "shingles": _item_shingles(_text, words)})
    held = held.withColumn("q", F.size("hashes")).withColumns({"least": least, "part": F.col("n") * 64 + F.floor(F.log2("q")).cast("int")})
    return held.withColumn("sketch", F.slice(F.array_sort("hashes"), 1, F.col("q") - F.col("least") + 1)).drop("hashes")


def bounds_of(sketches: DataFrame) -> list[tuple[int, int, int]]:
    """(part, n, largest sketch hash) of every partition: a few dozen whatever the number of items."""
    return sorted((r["part"], r["n"], r["top"]) for r in sketches.groupBy("part", "n").agg(F.max(F.element_at("sketch", -1)).alias("top")).collect())


def asked_hashes(split: DataFrame, bounds: list[tuple[int, int, int]]) -> DataFrame:
    """(doc_id, text_hash, part, h): for every partition, the shingle hashes of a document that its bound lets through."""
    each = split.select("doc_id", "text_hash", *(_windows("words", n, _hash).alias(f"h{n}") for n in sorted({n for _, n, _ in bounds})))


    def shown_to(part: int, n: int, top: int) -> Column:
        return F.transform(_up_to(F.col(f"h{n}"), top), lambda h: F.struct(F.lit(part).alias("part"), h.alias("h")))

    shown = [shown_to(part, n, top) for part, n, top in bounds]
    return each.select("doc_id", "text_hash", F.explode(F.concat(*shown)).alias("asked")).select("doc_id", "text_hash", "asked.part", "asked.h")


def _contained(docs: DataFrame, items: DataFrame, words: int, containment: float) -> DataFrame:
    """(doc_id, text_hash, item_id, item_shingles, shared_shingles)."""
    held = scratch.materialize(item_sketches(items, words, containment), "items")
    bounds = bounds_of(held)
    if not bounds:
        return docs.sparkSession.createDataFrame([], "doc_id long, text_hash long, item_id long, item_shingles int, shared_shingles int")
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL").withColumn("text_hash", F.xxhash64("text"))
    sketches = scratch.materialize(held.select("item_id", "part", F.explode("sketch").alias("h")), "sketches")
    seen = asked_hashes(text.select("doc_id", "text_hash", words_of(F.col("text")).alias("words")), bounds)
    seen = scratch.probably_in(seen, F.xxhash64("part", "h"), sketches.select(F.xxhash64("part", "h").alias("key")))
    pairs = scratch.materialize(seen.join(sketches, ["part", "h"]).select("doc_id", "text_hash", "item_id").distinct(), "candidates")
    asked = pairs.select(F.col("doc_id").alias("asked_doc"), F.col("text_hash").alias("asked_hash"), "item_id")
    likely = scratch.probably_in(text, F.col("text_hash"), pairs.select(F.col("text_hash").alias("key")))
    read = likely.join(asked, F.col("doc_id").eqNullSafe(F.col("asked_doc")) & (F.col("text_hash") == F.col("asked_hash"))).select("doc_id", "text_hash", "item_id", words_of(F.col("text")).alias("words"))
    both = read.join(held.select("item_id", "n", "least", "shingles"), "item_id")
    theirs = F.lit(None)
    for n in sorted({n for _, n, _ in bounds}):
        theirs = F.when(F.col("n") == n, _windows("words", n, _text)).otherwise(theirs)
    found = both.withColumns({"item_shingles": F.size("shingles"), "shared_shingles": F.size(F.array_intersect("shingles", theirs))})
    return found.where("shared_shingles >= least").select("doc_id", "text_hash", "item_id", "item_shingles", "shared_shingles").distinct()


def contained_items(docs: DataFrame, items: DataFrame, words: int = SHINGLE_WORDS, containment: float = CONTAINMENT) -> DataFrame:
    """(doc_id, item_id, item_shingles, shared_shingles) for every document that contains an item.

    ``docs``: doc_id, text; ``items``: item_id, text. An item of fewer than ``words`` words is looked for as a whole.
    Null and empty texts contain nothing and are contained in nothing; a null doc_id is reported as null; repeated rows
    are reported once. Other columns are ignored.
    """
    return _contained(docs, items, words, containment).select("doc_id", "item_id", "item_shingles", "shared_shingles").distinct()


def drop_contaminated(docs: DataFrame, items: DataFrame, words: int = SHINGLE_WORDS, containment: float = CONTAINMENT) -> DataFrame:
    """The rows of ``docs`` whose text contains no item, all columns as they are, whether doc_id is null or repeats."""
    bad = scratch.materialize(_contained(docs, items, words, containment).select(F.col("doc_id").alias("bad_doc_id"), F.col("text_hash").alias("bad_text_hash")).distinct(), "contaminated")
    same = (F.xxhash64(docs["text"].cast("string")) == bad["bad_text_hash"]) & docs["doc_id"].cast("long").eqNullSafe(bad["bad_doc_id"])
    return docs.join(bad, same, "left_anti")
