"""Repeated spans of tokens, by compaction of a De Bruijn graph.

Every ``window`` consecutive words of a document are an edge of a De Bruijn graph; its nodes are the runs one word
shorter. Neighbouring edges of a document that share their minimizer, the smallest hash among the ``anchor``-word runs
within the window, are found together and kept as one path from its first node to its last: equal edges have equal
minimizers, so equal stretches of text give equal paths. Paths whose minimizer occurs in one document only cannot
repeat and drop out. Where different paths share a minimizer (at the ends of repeated spans, around edits) the source
coordinates of one occurrence of each lead back to its words, and the edges are looked at one by one.

The distinct paths left are the graph: joins count the paths into and out of each node, and paths that meet at a node
with one of each, and follow each other in their source, compact into a unit. Repeats of one unit's neighbouring paths
in another document make one long span, and the words at its coordinates are compared with those at the source's: a
span whose words differ is no repeat. Nothing is paired: every step is a count, a minimum or a run by key, and a join
of written tables.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemill.llm import scratch
from tidemill.llm.hashing import BYTE_TABLE, WORD_BASE, range_hashes

WINDOW = 50
ANCHOR = 12
CHUNK_WORDS = 200_000  # a longer document is walked in overlapping stretches; paths may be cut anywhere
_SHIFT = 20  # a path's place is start << 20 | number of windows

def joined_words(text: str | None) -> bytes:
    """The words of a text (runs of bytes other than ASCII white space), one space between."""
    return b" ".join((text or "").encode("utf-8", "surrogatepass").split())


def word_bounds(joined: bytes) -> tuple[np.ndarray, np.ndarray]:
    if not joined:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    return np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(joined)]])


def _word_hashes(joined: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    first = int(starts[0])
    data = BYTE_TABLE[np.frombuffer(joined, np.uint8)[first : int(ends[-1])]]
    return range_hashes(data, starts - first, ends - first)


def window_hashes(joined: bytes, starts: np.ndarray, ends: np.ndarray, window: int) -> np.ndarray:
    words = _word_hashes(joined, starts, ends)
    at = np.arange(len(words) - window + 1)
    return range_hashes(words, at, at + window, WORD_BASE)


def minimizers(joined: bytes, starts: np.ndarray, ends: np.ndarray, window: int, anchor: int) -> np.ndarray:
    """For each window, the smallest hash of the ``anchor``-word runs in it."""
    low = window_hashes(joined, starts, ends, anchor)
    width, span = window - anchor + 1, 1
    while 2 * span <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    rest = width - span
    return np.minimum(low[: len(low) - rest], low[rest:]) if rest else low


def document_paths(joined: bytes, window: int = WINDOW, anchor: int = ANCHOR) -> Iterator[tuple[np.ndarray, ...]]:
    """(minimizer, content, first node, last node, start, windows) arrays of a document's paths."""
    starts, ends = word_bounds(joined)
    for at in range(0, max(len(starts) - window + 1, 0), CHUNK_WORDS):
        s, e = starts[at : at + CHUNK_WORDS + window - 1], ends[at : at + CHUNK_WORDS + window - 1]
        low = minimizers(joined, s, e, window, anchor)
        new = np.concatenate([[0], np.flatnonzero(low[1:] != low[:-1]) + 1])
        count = np.diff(np.concatenate([new, [len(low)]]))
        first, last = s[new].tolist(), e[new + count + window - 2].tolist()
        digest = xxhash.xxh3_64_digest
        content = np.frombuffer(b"".join([digest(joined[a:b]) for a, b in zip(first, last, strict=True)]), ">u8")
        nodes = window_hashes(joined, s, e, window - 1)
        yield low[new], content, nodes[new], nodes[new + count], new + at, count


def _paths(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            parts, owner, check, size = [], [], [], 0

            def flush() -> pa.RecordBatch:
                low, content, head, tail, start, count = (np.concatenate(x) for x in zip(*parts, strict=True))
                n = [len(p[0]) for p in parts]
                columns = [low.view(np.int64), content.astype(np.uint64).view(np.int64), head.view(np.int64), tail.view(np.int64), np.repeat(ids[owner], n).astype(np.int64), np.repeat(np.array(check, np.int64), n), start << _SHIFT | count]
                return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["low", "content", "head", "tail", "doc_id", "check", "place"])

            for i, t in enumerate(batch.column(1)):
                text = t.as_py()
                for p in document_paths(joined_words(text), window, anchor):
                    parts.append(p)
                    owner.append(i)
                    check.append(zlib.crc32(text.encode("utf-8", "surrogatepass")))
                    size += len(p[0])
                if size > 200_000:
                    yield flush()
                    parts, owner, check, size = [], [], [], 0
            if parts:
                yield flush()

    named = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    return named.mapInArrow(scratch.tidy(run), "low long, content long, head long, tail long, doc_id long, check long, place long")


def _packed(docs: DataFrame) -> DataFrame:
    """(doc_id, check, words): each document's joined words compressed, as they travel to joins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            for at in range(0, len(batch), 512):
                texts = [t or "" for t in batch.column(1).slice(at, 512).to_pylist()]
                check = [zlib.crc32(t.encode("utf-8", "surrogatepass")) for t in texts]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 512), pa.array(check, pa.int64()), pa.array([pack(joined_words(t)) for t in texts], pa.binary())], names=["doc_id", "check", "words"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(scratch.tidy(run), "doc_id long, check long, words binary")


def _edges(asked: DataFrame, window: int) -> DataFrame:
    """The single edges of paths: asked (words, doc_id, paths array<struct<low, content, place>>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for raw, doc, paths in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2), strict=True):
                joined = unpack(raw.as_py())
                starts, ends = word_bounds(joined)
                for p in paths.as_py():
                    at, n = p["place"] >> _SHIFT, p["place"] & (1 << _SHIFT) - 1
                    h = window_hashes(joined, starts[at : at + n + window - 1], ends[at : at + n + window - 1], window)
                    fixed = [pa.array(np.full(n, x, np.int64)) for x in (p["low"], p["content"], doc)]
                    yield pa.RecordBatch.from_arrays([*fixed, pa.array(h.view(np.int64)), pa.array(np.arange(n, dtype=np.int32))], names=["low", "content", "doc_id", "edge", "nth"])

    return asked.select("words", "doc_id", "paths").mapInArrow(scratch.tidy(_merged(run)), "low long, content long, doc_id long, edge long, nth int")


def _merged(run):
    """Small record batches of ``run`` put together."""

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in run(batches):
            held.append(b)
            n += len(b)
            if n > 100_000:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, n = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return merged


START, WINDOWS = f"shiftright(place, {_SHIFT})", f"place & {(1 << _SHIFT) - 1}"  # SQL
UNIT = ["source", "source_check", "unit"]


def _runs(df: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Rows (keys, ``at``, n, off) put together where they follow or overlap each other in ``at`` and ``off`` alike."""
    series = Window.partitionBy(*keys, "delta").orderBy(at)
    ends = F.max(F.col(at) + F.col("n")).over(series.rowsBetween(Window.unboundedPreceding, -1))
    cut = df.withColumn("delta", F.col(at) - F.col("off")).withColumn("new", F.coalesce((F.col(at) > ends).cast("int"), F.lit(1)))
    run = cut.withColumn("run", F.sum("new").over(series.rowsBetween(Window.unboundedPreceding, 0)))
    return run.groupBy(*keys, "delta", "run").agg(F.min(at).alias(at), F.max(F.col(at) + F.col("n")).alias("end"), F.min("off").alias("off")).select(*keys, at, (F.col("end") - F.col(at)).alias("n"), "off")


def compacted(known: DataFrame) -> DataFrame:
    """(low, content, source, source_check, unit, off): the unit each distinct path belongs to, as the place in its source where the unit starts, and the path's own place in the unit.

    ``known`` holds each distinct path once: low, content, head, tail and ``src``, its first occurrence.
    """
    sides = known.select(F.col("head").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("in")).unionAll(known.select("tail", F.lit(0), F.lit(1)))
    plain = sides.groupBy("node").agg(F.sum("out").alias("out"), F.sum("in").alias("in")).where("out = 1 AND `in` = 1").select(F.col("node").alias("head"), F.lit(True).alias("plain"))
    at = known.select("low", "content", "head", F.col("src.doc_id").alias("source"), F.col("src.check").alias("source_check"), F.col("src.place").alias("place")).join(plain, "head", "left")
    series = Window.partitionBy("source", "source_check").orderBy("start")
    at = at.select("low", "content", "source", "source_check", "plain", F.expr(START).alias("start"), F.expr(WINDOWS).alias("n"))
    follows = F.col("plain") & (F.lag(F.col("start") + F.col("n")).over(series) == F.col("start"))
    begun = at.withColumn("begin", F.when(~F.coalesce(follows, F.lit(False)), F.col("start")))
    unit = F.max("begin").over(series.rowsBetween(Window.unboundedPreceding, 0))
    return begun.withColumn("unit", unit).select("low", "content", *UNIT, (F.col("start") - F.col("unit")).alias("off"))


def _said(asked: DataFrame, window: int) -> DataFrame:
    """The words of spans: asked (words, doc_id, check, spans array<struct<UNIT, off, at, n, own>>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for raw, doc, check, spans in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                joined = unpack(raw.as_py())
                starts, ends = word_bounds(joined)
                listed = pa.RecordBatch.from_struct_array(spans.values)
                at, n = listed.column("at").to_numpy(), listed.column("n").to_numpy()
                said = [joined[a:b] for a, b in zip(starts[at].tolist(), ends[at + n + window - 2].tolist(), strict=True)]
                fixed = [pa.array(np.full(len(at), x, np.int64)) for x in (doc, check)]
                yield pa.RecordBatch.from_arrays([*fixed, *listed.columns, pa.array(said, pa.large_binary()).cast(pa.binary())], names=["doc_id", "check", *listed.schema.names, "said"])

    kind = "doc_id long, check long, source long, source_check long, unit long, off long, at long, n long, own boolean, said binary"
    return asked.select("words", "doc_id", "check", "spans").mapInArrow(scratch.tidy(_merged(run)), kind)


def differing(packed: DataFrame, hits: DataFrame, window: int) -> DataFrame:
    """(doc_id, check, at, n) of the hits whose words are not those at their source's coordinates."""
    own = hits.groupBy(*UNIT).agg(F.max(F.col("off") + F.col("n")).alias("n"))
    own = own.select(F.col("source").alias("doc_id"), F.col("source_check").alias("check"), *UNIT, F.lit(0).cast("long").alias("off"), F.col("unit").alias("at"), "n", F.lit(True).alias("own"))
    asked = hits.select("doc_id", "check", *UNIT, "off", "at", "n", F.lit(False).alias("own")).unionAll(own)
    asked = asked.groupBy("doc_id", "check").agg(F.collect_list(F.struct(*UNIT, "off", "at", "n", "own")).alias("spans"))
    said = scratch.materialize(_said(packed.join(asked, ["doc_id", "check"]), window), "said", "lz4")
    source = said.where("own").select(*UNIT, F.col("n").alias("all"), F.col("said").alias("true"))
    both = said.where("NOT own").join(source, UNIT)
    part = F.slice(F.split(F.col("true").cast("string"), " "), (F.col("off") + 1).cast("int"), (F.col("n") + window - 1).cast("int"))
    same = F.when((F.col("off") == 0) & (F.col("n") == F.col("all")), F.col("said") == F.col("true")).otherwise(F.col("said").cast("string") == F.array_join(part, " "))
    return both.where(~same).select("doc_id", "check", "at", "n").distinct()


def repeated_spans(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, check, spans): for each document with something to remove, the runs of windows (at, n) to remove."""
    path = ["low", "content"]
    paths = scratch.materialize(_paths(docs, window, anchor), "paths", "lz4")
    shared = paths.groupBy("low").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("low")
    shared = scratch.materialize(shared, "shared")
    kept = scratch.materialize(paths.join(shared, "low"), "repeated", "lz4")
    scratch.discard(paths, shared)
    known = kept.groupBy(*path).agg(F.min(F.struct("doc_id", "check", "place")).alias("src"), F.max("doc_id").alias("most"), F.min("head").alias("head"), F.min("tail").alias("tail"))
    known = scratch.materialize(known, "distinct", "lz4")
    units = scratch.materialize(compacted(known), "units", "lz4")
    several = scratch.materialize(known.groupBy("low").agg(F.count("*").alias("k")).where("k > 1").select("low"), "several")
    # One occurrence of each path that shares its minimizer with another leads back to its words.
    wanted = known.join(several, "low").groupBy("src.doc_id", "src.check").agg(F.collect_list(F.struct(*path, F.col("src.place").alias("place"))).alias("paths"))
    packed = _packed(docs)
    edges = scratch.materialize(_edges(packed.join(wanted, ["doc_id", "check"]), window), "edges", "lz4")
    first = edges.groupBy("low", "edge").agg(F.min(F.struct("doc_id", "content", "nth")).alias("told"), F.max("doc_id").alias("last")).where("told.doc_id < last")
    first = scratch.materialize(first.select("low", "edge", F.col("told.doc_id").alias("first"), F.col("told.content").alias("told"), F.col("told.nth").alias("told_nth")), "first")
    seen = edges.join(first, ["low", "edge"]).where("first < doc_id").select(*path, "nth", "told", "told_nth")
    source = units.select("low", F.col("content").alias("told"), *UNIT, "off")
    seen = seen.join(source, ["low", "told"]).select(*path, F.col("nth").cast("long").alias("rel"), F.lit(1).cast("long").alias("n"), *UNIT, (F.col("off") + F.col("told_nth")).alias("off"))
    some = known.select(*path, F.col("src.doc_id").alias("least")).join(_runs(seen, [*path, *UNIT], "rel"), path).select(*path, "least", F.lit(True).alias("part"), "rel", "n", *UNIT, "off")
    whole = known.where("src.doc_id < most").join(units, path).select(*path, F.col("src.doc_id").alias("least"), F.lit(False).alias("part"), F.lit(0).cast("long").alias("rel"), F.lit(None).cast("long").alias("n"), *UNIT, "off")
    targets = scratch.materialize(whole.unionAll(some), "targets", "lz4")
    found = kept.join(targets, path).where("IF(part, doc_id = least, doc_id > least)")
    found = found.select("doc_id", "check", (F.expr(START) + F.col("rel")).alias("at"), F.coalesce("n", F.expr(WINDOWS)).alias("n"), *UNIT, "off")
    hits = scratch.materialize(_runs(found, ["doc_id", "check", *UNIT], "at"), "hits", "lz4")
    scratch.discard(kept, known, units, several, edges, first, targets)
    wrong = scratch.materialize(differing(packed, hits, window), "differing")
    right = hits.join(wrong, ["doc_id", "check", "at", "n"], "left_anti")
    return right.groupBy("doc_id", "check").agg(F.collect_list(F.struct("at", "n")).alias("spans"))


def remove_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 (of the kept words joined by one space), and if wanted the kept ``text``.

    A word goes if a window covering it also starts in a document of a smaller doc_id. Null and empty texts have no
    words; a null doc_id keeps all its words and is no source. Rows that repeat a doc_id never count against each other.
    An empty table gives no rows; other columns are ignored.
    """
    scratch.prepare(docs)
    spans = scratch.materialize(repeated_spans(docs, window, anchor), "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for at in range(0, len(batch), 512):
                total, gone, sha, texts = [], [], [], []
                for raw, found in zip(batch.column(1).slice(at, 512).to_pylist(), batch.column(2).slice(at, 512), strict=True):
                    joined = unpack(raw)
                    n = joined.count(b" ") + 1 if joined else 0
                    edge = np.zeros(n + 1, np.int64)
                    for s in found.as_py() or ():
                        edge[s["at"]] += 1
                        edge[s["at"] + s["n"] + window - 1] -= 1
                    keep = np.cumsum(edge)[:n] == 0
                    if not keep.all():
                        joined = b" ".join(compress(joined.split(b" "), keep.tolist()))
                    total.append(n)
                    gone.append(n - int(keep.sum()))
                    sha.append(hashlib.sha256(joined).hexdigest())
                    texts.append(joined.decode("utf-8", "surrogatepass") if with_text else None)
                columns = {"doc_id": batch.column(0).slice(at, 512), "n_words": pa.array(total, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "kept_sha256": pa.array(sha, pa.string())}
                if with_text:
                    columns["text"] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_pydict(columns)

    return _packed(docs).join(spans, ["doc_id", "check"], "left").select("doc_id", "words", "spans").mapInArrow(scratch.tidy(run), "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", text string" * with_text)
