"""Embedding near-duplicates through an inverted multi-index.

Vectors are scaled to length one and cut in halves; each half has its own codebook, and the pairs of codewords form a
grid of cells. A multi-sequence traversal lists a vector's cells by the sum of its halves' distances. Every vector is
entered under its nearest cells and looks for others there; how many cells, is calibrated on a bounded sample to a
target recall at the similarity threshold. Vectors that meet are verified in double precision.

Equal vectors are first brought together with their count. A cell with many vectors is cut into blocks, and every pair
of blocks is compared by its own task group of bounded size, so no vector is left out. Pairs never leave a group: what
leaves are counts of links and the links of a spanning forest. A pair that meets in several cells counts in the first.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm import components, scratch

log = logging.getLogger(__name__)

THRESHOLD = 0.95
TARGET_RECALL = 0.999
#: Codebooks and the number of cells are fitted on this many distinct vectors at most, those of the smallest hash.
SAMPLE_VECTORS = 8_000
PER_CELL = 8  # distinct vectors a cell should hold
MAX_CODEWORDS = 1_024
BLOCK_VECTORS = 2_048
MOST_CELLS = 1_024
TRIED_CELLS = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128, 192, 256, 384, 512, 768, MOST_CELLS)


# --- the index ----------------------------------------------------------------------------------------------------


def codebook(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """k-means centres of the rows of ``x``."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        nearest = squared_distances(x, centres).argmin(1)
        count = np.bincount(nearest, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, nearest, x)
        used = count > 0
        centres[used] = total[used] / count[used, None]
    return centres


def squared_distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1), 0)


def nearest_cells(x: np.ndarray, books: tuple[np.ndarray, np.ndarray], cells: int) -> np.ndarray:
    """The first ``cells`` cells of each row's multi-sequence traversal, nearest first.

    A cell of rank r lies among the nearest r codewords of either half, so the two sorted lists need go no deeper.
    """
    half = x.shape[1] // 2
    out = []
    for at in range(0, len(x), 1024):
        part = x[at : at + 1024]
        lists = []
        for piece, book in zip((part[:, :half], part[:, half:]), books, strict=True):
            d = squared_distances(piece, book)
            deep = min(cells, len(book))
            i = np.argsort(d, axis=1, kind="stable")[:, :deep]
            lists.append((i, np.take_along_axis(d, i, 1)))
        (i, a), (j, b) = lists
        total = (a[:, :, None] + b[:, None, :]).reshape(len(part), -1)
        first = np.argsort(total, axis=1, kind="stable")[:, :cells]
        key = (i[:, :, None] * len(books[1]) + j[:, None, :]).reshape(len(part), -1)
        out.append(np.take_along_axis(key, first, 1))
    return np.concatenate(out) if out else np.zeros((0, cells), np.int64)


def meet(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each row, whether the two lists of cells share one."""
    return (a[:, :, None] == b[:, None, :]).any((1, 2))


def calibrate(sample: np.ndarray, books: tuple[np.ndarray, np.ndarray], threshold: float, target: float, seed: int = 11) -> tuple[int, float]:
    """(the fewest cells tried at which pairs at the threshold or above meet as often as ``target``, how often they do). It raises where MOST_CELLS are too few.

    The pairs are those within the sample and, so that a sample without any still tells, sampled vectors with copies
    turned away by random angles up to the threshold's.
    """
    rng = np.random.default_rng(seed)
    base = sample[: min(len(sample), 2_000)]
    noise = rng.standard_normal(base.shape)
    noise -= (noise * base).sum(1)[:, None] * base
    noise /= np.maximum(np.linalg.norm(noise, axis=1), 1e-12)[:, None]
    cos = rng.uniform(threshold, 1, len(base))[:, None]
    left, right = [base], [cos * base + np.sqrt(1 - cos * cos) * noise]
    near = base @ sample.T >= threshold
    near[np.arange(len(base)), np.arange(len(base))] = False
    i, j = np.nonzero(near)
    pick = rng.permutation(len(i))[:4_000]
    left.append(base[i[pick]])
    right.append(sample[j[pick]])
    a, b = np.concatenate(left), np.concatenate(right)
    most = len(books[0]) * len(books[1])
    reached = 0.0
    for cells in (c for c in TRIED_CELLS if c < min(most, MOST_CELLS + 1)):
        x, y = nearest_cells(a, books, cells), nearest_cells(b, books, cells)
        reached = float(np.mean(np.concatenate([meet(x[k : k + 16], y[k : k + 16]) for k in range(0, len(x), 16)])))
        if reached >= target:
            return cells, reached
    if most <= MOST_CELLS:
        return most, 1.0  # the whole grid
    raise ValueError(f"pairs meet with recall {reached:.4f} in {MOST_CELLS} cells, under the target of {target}")


# --- groups -------------------------------------------------------------------------------------------------------


def _forest(v: np.ndarray, threshold: float) -> tuple[list[int], list[int]]:
    """A spanning forest of the links among the rows of ``v``, as row numbers (root, member)."""
    left, roots, members = np.arange(len(v)), [], []
    while len(left) > 1:
        root, queue, left = int(left[0]), [int(left[0])], left[1:]
        while queue and len(left):
            near = v[left] @ v[queue.pop()] >= threshold
            found = left[near].tolist()
            queue += found
            members += found
            roots += [root] * len(found)
            left = left[~near]
    return roots, members


def _links(cell: int, x: int, y: int, g: np.ndarray, mult: np.ndarray, block: np.ndarray, cells: np.ndarray, v: np.ndarray, threshold: float):
    """Counts (g, n) and forest links (u, v) of one group: block x against block y of a cell."""
    if x == y:
        rows, cols = np.arange(len(g)), np.arange(len(g))
    else:
        rows, cols = np.flatnonzero(block == x), np.flatnonzero(block == y)
    i, j = np.nonzero(v[rows] @ v[cols].T >= threshold - 1e-9)
    i, j = rows[i], cols[j]
    if x == y:
        i, j = i[i < j], j[i < j]
    # Decided by the plain sum of products, whatever order a matrix product adds in.
    linked = np.concatenate([np.einsum("ij,ij->i", v[i[k : k + 65_536]], v[j[k : k + 65_536]]) >= threshold for k in range(0, len(i), 65_536)] or [np.zeros(0, bool)])
    i, j = i[linked], j[linked]
    if not len(i):
        return None
    count = np.zeros(len(g))
    for k in range(0, len(i), 16_384):
        a, b = i[k : k + 16_384], j[k : k + 16_384]
        shared = np.where((cells[a][:, :, None] == cells[b][:, None, :]).any(2), cells[a], np.iinfo(np.int64).max).min(1)
        a, b = a[shared == cell], b[shared == cell]
        count += np.bincount(a, mult[b], len(g)) + np.bincount(b, mult[a], len(g))
    used = np.unique(np.concatenate([i, j]))
    if x == y:
        u, w = _forest(v[used], threshold)
        u, w = g[used[u]], g[used[w]]
    else:
        # Both sides' links to the smallest of their partners, and on until labels settle, keep what is linked together.
        label = np.arange(len(g))
        while True:
            new = label.copy()
            np.minimum.at(new, i, label[j])
            np.minimum.at(new, j, new[i])
            if (new == label).all():
                break
            label = new
        u, w = g[label[used]], g[used]
        u, w = u[u != w], w[u != w]
    some = np.flatnonzero(count)
    return g[some], count[some].astype(np.int64), u, w


def _same_length(valid: DataFrame, dims: int, threshold: float, target: float) -> DataFrame:
    """(v, n_links, component_id) for each distinct vector of ``dims`` numbers in ``valid`` (vec_id, v)."""
    spark, kind = valid.sparkSession, valid.schema["v"].dataType.simpleString()
    distinct = valid.where(F.size("v") == dims).groupBy("v").agg(F.count("*").alias("mult"), F.min("vec_id").alias("first"))
    distinct = scratch.materialize(distinct.withColumn("g", F.monotonically_increasing_id()), "vectors")
    n = distinct.count()
    width = dims + dims % 2

    def unit(values: pa.Array) -> np.ndarray:
        flat = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
        x = np.zeros((len(flat), width))
        x[:, :dims] = flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
        x /= np.abs(x).max(1, initial=0)[:, None]  # squares of very large or small numbers would leave the range
        return x / np.linalg.norm(x, axis=1)[:, None]

    sample = unit(distinct.orderBy(F.xxhash64("v"), "v").limit(SAMPLE_VECTORS).select("v").toArrow()["v"])
    k = int(np.clip(np.sqrt(n / PER_CELL), 1, min(MAX_CODEWORDS, max(1, len(sample) // 4))))
    books = (codebook(sample[:, : width // 2], k, 1), codebook(sample[:, width // 2 :], k, 2))
    t, recall = calibrate(sample, books, threshold, target)
    log.info("%d vectors of %d numbers: %d codewords a half, %d cells a vector, recall %.4f on the sample", n, dims, k, t, recall)
    shared = spark.sparkContext.broadcast(books)  # at most 2 x MAX_CODEWORDS half vectors

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 2_048):
                part = batch.slice(at, 2_048)
                x = unit(part.column(2))
                cells = nearest_cells(x, shared.value, t)
                row = pa.array(np.repeat(np.arange(len(x)), cells.shape[1]))
                lists = pa.FixedSizeListArray.from_arrays(pa.array(np.sort(cells, axis=1).ravel()), cells.shape[1]).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(cells.ravel()), part.column(0).take(row), part.column(1).take(row), lists.take(row), part.column(2).take(row)], names=["cell", "g", "mult", "cells", "v"])

    entries = scratch.materialize(distinct.select("g", "mult", "v").mapInArrow(scratch.tidy(enter), f"cell long, g long, mult long, cells array<long>, v {kind}"), "entries")
    sizes = scratch.materialize(entries.groupBy("cell").agg(F.count("*").alias("size")).where("size > 1").withColumn("blocks", F.ceil(F.col("size") / BLOCK_VECTORS).cast("int")), "cells")
    own = F.pmod(F.xxhash64("g"), F.col("blocks")).cast("int")
    dealt = entries.join(sizes, "cell").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("cell", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "g", "mult", "cells", "v")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def results(table: pa.Table) -> Iterator[pa.RecordBatch]:
            head = np.stack([table[c].to_numpy().astype(np.int64) for c in ("cell", "x", "y")], 1)
            new = np.flatnonzero((head[1:] != head[:-1]).any(1)) + 1
            g, mult, block = (table[c].to_numpy() for c in ("g", "mult", "own"))
            cells = table["cells"].combine_chunks().flatten().to_numpy().reshape(len(table), -1)
            v = unit(table["v"])
            a, b, m = [], [], []
            for s, e in zip([0, *new.tolist()], [*new.tolist(), len(table)], strict=True):
                if e - s > 1 and (found := _links(*head[s].tolist(), g[s:e], mult[s:e], block[s:e], cells[s:e], v[s:e], threshold)):
                    who, count, left, right = found
                    a += [who, left]
                    b += [np.full(len(who), -1), right]
                    m += [count, np.zeros(len(left), np.int64)]
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(z).astype(np.int64)) for z in (a, b, m)], names=["a", "b", "n"])

        for table in scratch.whole_groups(batches, ["cell", "x", "y"]):
            yield from results(table)

    found = scratch.materialize(dealt.repartition("cell", "x", "y").sortWithinPartitions("cell", "x", "y").mapInArrow(scratch.tidy(compare), "a long, b long, n long"), "found")
    counts = scratch.materialize(found.where("b < 0").groupBy(F.col("a").alias("g")).agg(F.sum("n").alias("n")), "counts")
    members = scratch.materialize(components.connected_components(found.where("b >= 0").select(F.col("a").alias("u"), F.col("b").alias("v"))).withColumnRenamed("node", "g"), "members")
    firsts = distinct.select("g", "first")
    named = members.join(firsts, "g").groupBy("component").agg(F.min("first").alias("component_id"))
    joint = scratch.materialize(members.join(scratch.materialize(named, "named"), "component").select("g", "component_id"), "joint")
    out = distinct.join(counts, "g", "left").join(joint, "g", "left")
    return out.select("v", (F.col("mult") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component_id", "first").alias("component_id"))


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, target_recall: float = TARGET_RECALL) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of ``vectors`` (vec_id, embedding).

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, and vectors link only
    with those of their own length. Repeated rows are vectors of their own. A null vec_id never names a component and
    is never kept. An empty table gives no rows; other columns are ignored.
    """
    scratch.prepare(vectors)
    # Single precision travels as it is and is widened where it is compared.
    kind = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    judged = base.withColumn("ok", F.coalesce(finite, F.lit(False)))
    valid, rest = judged.where("ok"), judged.where("NOT ok")
    out = rest.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    lengths = [r["d"] for r in valid.groupBy(F.size("v").alias("d")).count().collect()]  # a row for each length of vector
    for d in sorted(lengths):
        classes = scratch.materialize(_same_length(valid.select("vec_id", "v"), d, threshold, target_recall), "classes")
        out = out.unionByName(valid.where(F.size("v") == d).join(classes, "v").select("vec_id", "n_links", "component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
