"""SimHash near-duplicates through meet-in-the-middle ball hashing.

A 64-bit fingerprint is cut into ``blocks`` equal blocks. If two fingerprints differ in at most ``radius`` bits, some
block of theirs differs in at most r = radius // blocks bits, and then some value lies within (r + 1) // 2 bits of
that block in both. So every distinct fingerprint emits, for each block, all variants within half that radius; the
variants are shuffled, and fingerprints that meet on a variant are verified on all 64 bits. With one block this is
the plain form: for radius 4 each fingerprint emits 2,081 variants. With two blocks, the default, it emits 66 and
finds exactly the same pairs; see the README for the figures of both.

Fingerprints that meet are never paired off: only the links of spanning forests leave a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm import components, scratch

SHINGLE_WORDS = 4
RADIUS = 4
BLOCKS = 2
SEED = 42
EMIT_ROWS = 500_000


# --- fingerprints -------------------------------------------------------------------------------------------------


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """Bit i is 1 if it is set in over half of the shingles' XXH64; 0 for a text without words.

    Words are runs of bytes other than ASCII white space, A-Z lower-cased; shingles repeat as often as they occur.
    """
    import xxhash

    joined = b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split())
    if not joined:
        return 0
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    digest = xxhash.xxh64_digest
    if len(gaps) + 1 <= words:
        hashes = digest(joined, SEED)
    else:
        starts = [0, *(gaps[: len(gaps) - words + 2] + 1).tolist()]
        ends = [*gaps[words - 1 :].tolist(), len(joined)]
        hashes = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts, ends, strict=False)])
    rows = np.frombuffer(hashes, np.uint8).reshape(-1, 8)
    total = np.zeros(64, np.int64)
    for i in range(0, len(rows), 65_536):
        total += np.unpackbits(rows[i : i + 65_536], axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(rows)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t.as_py(), words) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(scratch.tidy(run), "doc_id long, fp long")


# --- ball hashing -------------------------------------------------------------------------------------------------


def ball(bits: int, radius: int) -> np.ndarray:
    """All masks of at most ``radius`` of ``bits`` bits."""
    return np.array([sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(bits), r)], np.uint64)


def variants(fps: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(block, variant, fp): what each distinct fingerprint emits."""
    width = 64 // blocks
    masks = ball(width, (radius // blocks + 1) // 2)
    low = np.uint64((1 << width) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = batch.column(0).to_numpy()
            for at in range(0, len(whole), max(1, EMIT_ROWS // len(masks))):
                fp = whole[at : at + max(1, EMIT_ROWS // len(masks))]
                for b in range(blocks):
                    part = (fp.view(np.uint64) >> np.uint64(b * width)) & low
                    key = (part[:, None] ^ masks[None, :]).ravel().view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), b, np.int32)), pa.array(key), pa.array(np.repeat(fp, len(masks)))], names=["block", "variant", "fp"])

    return fps.mapInArrow(scratch.tidy(run), "block int, variant long, fp long")


def forest(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (root, member) of a spanning forest of distinct fingerprints under distance <= radius."""
    left, roots, members = fps, [], []
    while len(left) > 1:
        root, queue, left = left[0], [left[0]], left[1:]
        while queue and len(left):
            near = np.bitwise_count(left ^ queue.pop()) <= radius
            if near.any():
                found = left[near]
                queue.extend(found)
                members.append(found)
                roots.append(np.full(len(found), root, fps.dtype))
                left = left[~near]
    none = np.zeros(0, fps.dtype)
    return np.concatenate([none, *roots]), np.concatenate([none, *members])


def fingerprint_links(fps: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(u, v) links whose components are those of all pairs of distinct fingerprints within ``radius`` bits."""

    def links(b: np.ndarray, k: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        new = np.flatnonzero((k[1:] != k[:-1]) | (b[1:] != b[:-1])) + 1
        starts, ends = np.concatenate([[0], new]), np.concatenate([new, [len(k)]])
        size = ends - starts
        two = starts[size == 2]
        x, y = fp[two], fp[two + 1]
        near = np.bitwise_count(x ^ y) <= radius
        us, vs = [x[near]], [y[near]]
        for s, e in zip(starts[size > 2].tolist(), ends[size > 2].tolist(), strict=True):
            u, v = forest(fp[s:e], radius)
            us.append(u)
            vs.append(v)
        return np.concatenate(us).view(np.int64), np.concatenate(vs).view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = scratch.whole_groups(batches, ["block", "variant"])
        found = (links(*(t[c].to_numpy() for c in ("block", "variant")), t["fp"].to_numpy().view(np.uint64)) for t in groups)
        for u, v in components.spanning_links(found):
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    met = variants(fps, radius, blocks).repartition("block", "variant").sortWithinPartitions("block", "variant")
    return met.mapInArrow(scratch.tidy(run), "u long, v long")


def near_duplicates(docs: DataFrame, words: int = SHINGLE_WORDS, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs`` (doc_id, text): the smallest doc_id reachable over links of at most ``radius`` bits.

    Null and empty texts have fingerprint zero and link like any other. A null doc_id belongs to its component but
    never names it; a component of such rows alone has a null id. Repeated rows give repeated results. Other columns
    are ignored.
    """
    scratch.prepare(docs)
    fps = scratch.materialize(fingerprints(docs, words), "fingerprints")
    least = scratch.materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    links = fingerprint_links(least.select("fp"), radius, blocks)
    linked = scratch.materialize(components.connected_components(links).withColumnRenamed("node", "fp"), "members")
    named = linked.join(least, "fp").groupBy("component").agg(F.min("first").alias("component_id"))
    named = scratch.materialize(named, "named")
    joint = linked.join(named, "component").select("fp", "component_id")
    classes = scratch.materialize(least.join(joint, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id")), "classes")
    return fps.join(classes, "fp").select("doc_id", "fp", "component_id")


# --- documents of a given similarity ------------------------------------------------------------------------------

SKETCH_BITS = 512
PASS_BITS = 128  # of the sketch, carried along to judge what meets
TARGET_RECALL = 0.98
SMALL_GROUP = 256  # up to this size all pairs of a group are compared at once, beyond it a forest is grown
LOOSE_SIGMAS = 3  # what meets is let through up to so many standard deviations over the mean
#: Sets of few shingles differ in more bits than the limit for large sets says: 3/16 for 4 of 5 shared, the worst at 0.8.
SHORT_SHINGLES, SHORT_DISAGREEMENT = 16, 0.1875
BLOCK_DOCUMENTS = 256  # of a loose group that are compared with as many others in one piece
_SPREAD = np.array([2 * k + 1 for k in np.random.default_rng(64).integers(1 << 60, 1 << 62, SKETCH_BITS // 64).tolist()], np.uint64)


def disagreement(similarity: float) -> float:
    """The share of bits in which sketches of two shingle sets of one size and Jaccard ``similarity`` differ."""
    return float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the text's ``words``-word shingles, A-Z lower-cased; a shorter text is one shingle, no words are none."""
    import xxhash

    joined = b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split())
    if not joined:
        return np.zeros(0, np.uint64)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    digest = xxhash.xxh3_64_digest
    if len(gaps) + 1 <= words:
        hashes = digest(joined)
    else:
        starts = [0, *(gaps[: len(gaps) - words + 2] + 1).tolist()]
        ends = [*gaps[words - 1 :].tolist(), len(joined)]
        hashes = b"".join([digest(joined[a:b]) for a, b in zip(starts, ends, strict=False)])
    return np.unique(np.frombuffer(hashes, np.uint64))


def set_sketch(h: np.ndarray) -> bytes:
    """A SimHash of ``SKETCH_BITS`` bits over a set of shingles; zero bits for none."""
    total = np.zeros(SKETCH_BITS, np.int64)
    for i in range(0, len(h), 16_384):
        with np.errstate(over="ignore"):
            wide = (h[i : i + 16_384, None] ^ (h[i : i + 16_384, None] >> np.uint64(31))) * _SPREAD
            wide ^= wide >> np.uint64(29)
        total += np.unpackbits(wide.view(np.uint8).reshape(len(wide), -1), axis=1).sum(0, dtype=np.int64)
    return np.packbits(2 * total > len(h)).tobytes()


def sketch(text: str | None, words: int) -> bytes:
    """A SimHash of ``SKETCH_BITS`` bits over the set of the text's ``words``-word shingles; zero bits for no words."""
    return set_sketch(shingle_set(text, words))


def tables_for(n: int, p: float, recall: float = TARGET_RECALL) -> tuple[int, int]:
    """(bits, tables): key bits with which about ``4 * (bits + 1)`` of n sketches meet by chance, and tables in which pairs that differ in a share p of their bits meet with the recall."""
    bits = int(np.clip(np.ceil(np.log2(max(n, 1))) - 2, 12, 32))
    meets = (1 - p) ** bits + bits * p * (1 - p) ** (bits - 1) + bits * (bits - 1) / 2 * p * p * (1 - p) ** (bits - 2)
    return bits, int(np.ceil(np.log(1 - recall) / np.log(1 - meets)))


def _pass_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int64)


def _group_links(g: np.ndarray, f: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of one large group, each member to the one that reached it."""
    left, us, vs = np.arange(len(g)), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop(0)
            near = _pass_distance(f[left], f[at]) <= most
            found = left[near]
            queue.extend(found)
            us.append(np.full(len(found), at))
            vs.append(found)
            left = left[~near]
    return g[np.concatenate(us)], g[np.concatenate(vs)]


def similar_links(sketches: DataFrame, similarity: float, n: int) -> DataFrame:
    """(u, v) links among sketched sets (g, size, bits) whose components are those of all pairs that met in some table and may be alike by their carried bits.

    Sets of few shingles meet in further tables, made for the larger share of bits in which they may differ.
    """
    p = disagreement(similarity)
    bits, common = tables_for(n, p)
    tables = common + tables_for(n, max(p, SHORT_DISAGREEMENT))[1]
    rng = np.random.default_rng(9)
    chosen = np.stack([rng.permutation(SKETCH_BITS - PASS_BITS)[:bits] for _ in range(tables)]) + PASS_BITS
    masks = ball(bits, 1).view(np.int64)
    most, most_short = (int(PASS_BITS * x + LOOSE_SIGMAS * np.sqrt(PASS_BITS * x * (1 - x))) for x in (p, max(p, SHORT_DISAGREEMENT)))
    weights = 1 << np.arange(bits, dtype=np.int64)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, short = batch.column(0).to_numpy(), batch.column(1).to_numpy() <= SHORT_SHINGLES
            raw = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(len(ids), -1)
            for at in range(0, len(ids), 8_192):
                g, part = ids[at : at + 8_192], raw[at : at + 8_192]
                ones = np.unpackbits(part, axis=1)
                f = np.ascontiguousarray(part[:, : PASS_BITS // 8]).view(np.int64)
                every, few = np.arange(len(g)), np.flatnonzero(short[at : at + 8_192])
                for t in range(tables):
                    use = every if t < common else few
                    row = np.repeat(use, len(masks))
                    key = ones[use[:, None], chosen[t]] @ weights
                    key = (key[:, None] ^ masks[None, :]).ravel() | t << 33
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(g[row]), pa.array(f[row, 0]), pa.array(f[row, 1])], names=["key", "g", "f0", "f1"])

    def links(key: np.ndarray, g: np.ndarray, f0: np.ndarray, f1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        f = np.stack([f0, f1], 1).view(np.uint64)
        new = np.flatnonzero(key[1:] != key[:-1]) + 1
        starts, ends = np.concatenate([[0], new]), np.concatenate([new, [len(key)]])
        size = np.repeat(ends - starts, ends - starts)
        us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for d in range(1, min(SMALL_GROUP, int(size.max()))):
            i = np.flatnonzero((key[:-d] == key[d:]) & (size[d:] <= SMALL_GROUP))
            i = i[_pass_distance(f[i], f[i + d]) <= np.where(key[i] >> 33 < common, most, most_short)]
            us.append(g[i])
            vs.append(g[i + d])
        for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
            if e - s > SMALL_GROUP:
                u, v = _group_links(g[s:e], f[s:e], most if key[s] >> 33 < common else most_short)
                us.append(u)
                vs.append(v)
        return np.concatenate(us), np.concatenate(vs)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (links(*(t[c].to_numpy() for c in ("key", "g", "f0", "f1"))) for t in scratch.whole_groups(batches, ["key"]))
        for u, v in components.spanning_links(found):
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    met = sketches.select("g", "size", "bits").mapInArrow(scratch.tidy(emit), "key long, g long, f0 long, f1 long")
    return met.repartition("key").sortWithinPartitions("key").mapInArrow(scratch.tidy(compare), "u long, v long").distinct()


def alike(shared: np.ndarray, a: np.ndarray | int, b: np.ndarray | int, similarity: float) -> np.ndarray:
    """Whether sets of a and b elements with so many shared have that Jaccard similarity or more."""
    return shared >= similarity * (a + b - shared) - 1e-9


def exact_forest(sets: list[np.ndarray], similarity: float, sides: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links (root, member) of a spanning forest of the sets whose exact Jaccard similarity reaches ``similarity``; with ``sides``, over pairs of two sides only."""
    sizes = np.array([len(x) for x in sets])
    flat, at = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    owner = np.repeat(np.arange(len(sets)), sizes)
    inside = np.zeros(len(flat), bool)
    left = np.ones(len(sets), bool)
    roots, members = [], []
    for root in range(len(sets)):
        queue = [root] if left[root] else []
        left[root] = False
        while queue and left.any():
            one = queue.pop()
            mine = at[starts[one] : starts[one + 1]]
            inside[mine] = True
            shared = np.bincount(owner[inside[at]], minlength=len(sets))
            inside[mine] = False
            near = left & alike(shared, sizes, sizes[one], similarity)
            if sides is not None:
                near &= sides != sides[one]
            found = np.flatnonzero(near)
            queue += found.tolist()
            roots.append(np.full(len(found), root))
            members.append(found)
            left[found] = False
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *roots]), np.concatenate([none, *members])


def exact_links(loose: DataFrame, similarity: float) -> DataFrame:
    """(u, v) links whose components are those of all pairs of one loose group with exact similarity, from (component, g, shingles).

    Rows may repeat. A group is cut into blocks, and every pair of blocks is compared in a piece of its own.
    """
    sizes = scratch.materialize(loose.groupBy("component").agg(F.count_distinct("g").alias("n")).withColumn("blocks", F.ceil(F.col("n") / BLOCK_DOCUMENTS).cast("int")), "loose")
    own = F.pmod(F.xxhash64("g"), F.col("blocks")).cast("int")
    dealt = loose.join(sizes, "component").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("component", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "g", "shingles")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for table in scratch.whole_groups(batches, ["component", "x", "y"]):
            head = np.stack([table[c].to_numpy().astype(np.int64) for c in ("component", "x", "y")], 1)
            new = np.flatnonzero((head[1:] != head[:-1]).any(1)) + 1
            g, side = table["g"].to_numpy(), table["own"].to_numpy()
            for s, e in zip([0, *new.tolist()], [*new.tolist(), len(table)], strict=True):
                one = s + np.unique(g[s:e], return_index=True)[1]  # rows that repeat
                if len(one) > 1:
                    sets = [np.frombuffer(b, np.uint64) for b in table["shingles"].take(pa.array(one)).to_pylist()]
                    u, v = exact_forest(sets, similarity, side[one] if head[s, 1] != head[s, 2] else None)
                    yield g[one[u]], g[one[v]]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for u, v in components.spanning_links(pieces(batches)):
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return dealt.repartition("component", "x", "y").sortWithinPartitions("component", "x", "y").mapInArrow(scratch.tidy(compare), "u long, v long")


def similar_documents(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, component_id) for every row of ``docs`` (doc_id, text): groups of documents at the similarity or above.

    Similarity is that of the sets of ``words``-word shingles. Sketches of 512 bits say which sets may be alike: their
    bits are dealt into tables; in each, every sketch emits all variants within one bit of its key, half of the two
    bits by which a pair may differ there. What meets and is not far apart forms loose groups, and within these the
    shingle sets themselves decide, every pair of them. Null and empty texts are alike. A null doc_id belongs to its
    group but never names it.
    """
    import xxhash

    scratch.prepare(docs)
    # A row is found again by its id and the hash of its text.
    given = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumns({"d": F.coalesce("doc_id", F.lit(0)), "h": F.xxhash64("text")})
    name = lambda s: xxhash.xxh3_128_digest(s.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py(), words) for t in batch.column(3)]
            made = [pa.array([name(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_sketch(s) for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *made], names=["doc_id", "d", "h", "name", "size", "bits"])

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py(), words) for t in batch.column(3)]
            same = pa.array([name(s) == k.as_py() for s, k in zip(sets, batch.column(2), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([c.filter(same) for c in (batch.column(0), batch.column(1), pa.array([s.tobytes() for s in sets], pa.binary()))], names=["component", "g", "shingles"])

    made = scratch.materialize(given.select("doc_id", "d", "h", "text").mapInArrow(scratch.tidy(run), "doc_id long, d long, h long, name binary, size long, bits binary"), "sketches")
    distinct = made.groupBy("name", "size", "bits").agg(F.min("doc_id").alias("first"), F.min(F.struct("d", "h")).alias("row"))
    distinct = scratch.materialize(distinct.select("name", "size", "bits", "first", "row.d", "row.h").withColumn("g", F.monotonically_increasing_id()), "distinct")
    loose = components.connected_components(similar_links(distinct.where("size > 0"), similarity, distinct.count())).withColumnRenamed("node", "g")
    asked = scratch.materialize(loose.join(distinct.select("g", "name", "d", "h"), "g"), "asked")
    texts = scratch.probably_in(given.select("d", "h", "text"), F.xxhash64("d", "h"), asked.select(F.xxhash64("d", "h").alias("key")))
    sets = asked.join(texts, ["d", "h"]).select("component", "g", "name", "text").mapInArrow(scratch.tidy(shingles), "component long, g long, shingles binary")
    links = exact_links(scratch.materialize(sets, "sets"), similarity)
    members = scratch.materialize(components.connected_components(links).withColumnRenamed("node", "g"), "members")
    named = scratch.materialize(members.join(distinct.select("g", "first"), "g").groupBy("component").agg(F.min("first").alias("component_id")), "named")
    joint = scratch.materialize(members.join(named, "component").select("g", "component_id"), "joint")
    classes = scratch.materialize(distinct.join(joint, "g", "left").select("name", F.coalesce("component_id", "first").alias("component_id")), "classes")
    return made.join(classes, "name").select("doc_id", "component_id")


def keep_one_of_each(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` without the documents whose group holds a smaller doc_id. Rows that share a doc_id are one document and stay or go together; rows with a null doc_id stay."""
    groups = similar_documents(docs, words, similarity)
    gone = scratch.materialize(groups.where("doc_id <> component_id").select(F.col("doc_id").alias("gone_doc_id")).distinct(), "gone")
    return docs.join(gone, docs["doc_id"] == gone["gone_doc_id"], "left_anti")
