"""Token ids as compact binary files: canonical length-limited Huffman codes in independently decodable blocks.

File format: a folder with two Parquet datasets, so that any store Spark reaches can hold it.

``codebook``: one row (symbol int, bits int) for each id that occurs. Codes are canonical: by length, then by id.
``blocks``: one row for each block, rows in ascending (shard, block) and so in ascending doc_id order:
    shard int, block int    place in the order
    before long             ids in the shard's earlier blocks
    n_ids long              ids in the block
    doc_ids binary          int64 little-endian, one for each document of the block (0 where null, see null_ids)
    null_ids binary         positions of documents whose id is null, int32
    counts binary           ids of each document, int32, the end id included
    bits binary             uint16, the bit length of each run of ``CHECKPOINT`` ids; their running sum is the bit
                            offset of each run's start, so runs decode independently
    payload binary          the codes, first bit highest
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import bpe, scratch

END_ID = 0
MAX_BITS = 16
CHECKPOINT = 64
BLOCK_IDS = 65_536

BLOCKS = "shard int, block int, before long, n_ids long, doc_ids binary, null_ids binary, counts binary, bits binary, payload binary"


# --- codes --------------------------------------------------------------------------------------------------------


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits by package-merge; 0 for symbols that do not occur."""
    out = np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts)
    n = len(used)
    if n > 1 << limit:
        raise ValueError(f"{n} symbols need more than {limit} bits")
    if n <= 1:
        out[used] = 1
        return out
    order = used[np.argsort(counts[used], kind="stable")]
    weight = counts[order].astype(np.float64)
    levels, merged = [], weight
    leaf = np.ones(n, bool)
    for _ in range(limit - 1):
        levels.append(leaf)
        half = len(merged) // 2
        pairs = merged[: 2 * half].reshape(-1, 2).sum(1)
        joint = np.concatenate([weight, pairs])
        at = np.argsort(joint, kind="stable")
        merged, leaf = joint[at], at < n
    levels.append(leaf)
    take, depth = 2 * n - 2, np.zeros(n, np.int64)
    for leaf in reversed(levels):
        leaves = int(leaf[:take].sum())
        depth[:leaves] += 1  # leaves appear in order of weight
        take = 2 * (take - leaves)
    out[order] = depth
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes by length, then symbol."""
    codes = np.zeros(len(lengths), np.uint64)
    code = last = 0
    for s in np.lexsort((np.arange(len(lengths)), lengths)).tolist():
        if n := int(lengths[s]):
            code <<= n - last
            codes[s], last = code, n
            code += 1
    return codes


def decoding_table(lengths: np.ndarray, limit: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """For every value of the next ``limit`` bits: the symbol that they begin with and its length."""
    codes = canonical_codes(lengths)
    symbol, bits = np.zeros(1 << limit, np.uint32), np.zeros(1 << limit, np.int64)
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    spans = 1 << (limit - lengths[order])
    end = int(spans.sum())
    symbol[:end], bits[:end] = np.repeat(order, spans), np.repeat(lengths[order], spans)
    assert not len(order) or int(codes[order[0]]) == 0
    return symbol, bits


def encode_block(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, bytes]:
    """(bits, payload) of a block of ids."""
    n = lengths[ids]
    ends = np.cumsum(n)
    starts = ends - n
    runs = np.diff(np.concatenate([starts[::CHECKPOINT], ends[-1:]])).astype("<u2")
    word, shift = starts >> 5, 64 - (starts & 31) - n
    value = codes[ids] << shift.astype(np.uint64)
    size = (int(ends[-1]) + 31 >> 5) + 1 if len(ids) else 0
    # Codes do not overlap, so sums are unions; each stays under 2**32 and so is exact as a float.
    high = np.bincount(word, (value >> np.uint64(32)).astype(float), size)
    low = np.bincount(word + 1, (value & np.uint64(0xFFFFFFFF)).astype(float), size + 1)[:size]
    return runs.tobytes(), (high + low).astype(">u4").tobytes()


def decode_block(bits: bytes, payload: bytes, total: int, symbol: np.ndarray, length: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """The ``total`` ids of a block: all its checkpointed runs advance together, one id each at a step."""
    runs = np.frombuffer(bits, "<u2").astype(np.int64)
    at = np.cumsum(runs) - runs
    words = np.concatenate([np.frombuffer(payload, ">u4").astype(np.uint64), np.zeros(2, np.uint64)])
    out = np.zeros((len(runs), CHECKPOINT), np.uint32)
    last, mask = len(words) - 2, np.uint64((1 << limit) - 1)
    for k in range(min(CHECKPOINT, total)):
        w = np.minimum(at >> 5, last)
        both = (words[w] << np.uint64(32)) | words[w + 1]
        peek = (both >> (64 - limit - (at & 31)).astype(np.uint64)) & mask
        out[:, k] = symbol[peek]
        at = at + length[peek]
    return out.ravel()[:total]


# --- writing and reading ------------------------------------------------------------------------------------------


def tokenized(docs: DataFrame, vocabulary: str, end_id: int = END_ID) -> DataFrame:
    """(doc_id, ids): each whole text's ids and the end id, two bytes an id. A null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, end = bpe.tokenizer(vocabulary), np.array([end_id], "<u2").tobytes()
        for batch in batches:
            for at, texts in bpe.slices(batch.column(1)):
                raw = [x + end for x in tok.encode(texts)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(raw, pa.binary())], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(scratch.tidy(run), "doc_id long, ids binary")


def global_counts(ids: DataFrame, size: int = 65_536) -> np.ndarray:
    """Occurrences of each id: summed within each task, then by id; a row for each id of the vocabulary reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u2"), minlength=size)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["symbol", "n"])

    counts = np.zeros(size, np.int64)
    for r in ids.select("ids").mapInArrow(scratch.tidy(run), "symbol int, n long").groupBy("symbol").agg(F.sum("n").alias("n")).collect():
        counts[r["symbol"]] = r["n"]
    return counts


def write_token_files(docs: DataFrame, path: str, vocabulary: str, end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> None:
    """Write the ids of ``docs`` (doc_id, text) to ``path`` in ascending doc_id order, null ids first.

    Rows that repeat a doc_id stand next to each other, ordered by a hash of their ids, so that many of them spread over
    shards. An empty table gives an empty file set. The intermediate ids are deleted once the files stand.
    """
    spark = scratch.prepare(docs)
    ids = scratch.materialize(tokenized(docs, vocabulary, end_id), "ids")
    lengths = code_lengths(global_counts(ids))
    codes = canonical_codes(lengths)
    used = np.flatnonzero(lengths)
    book = [(int(s), int(lengths[s])) for s in used]
    spark.createDataFrame(book, "symbol int, bits int").coalesce(1).write.parquet(f"{path}/codebook")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, number, before, held, size = TaskContext.get().partitionId(), 0, 0, [], 0

        def flush() -> pa.RecordBatch:
            nonlocal number, before, held, size
            all_ids = np.frombuffer(b"".join(raw for _, raw in held), "<u2")
            bits, payload = encode_block(all_ids, codes, lengths)
            names = np.array([i or 0 for i, _ in held], "<i8").tobytes()
            nulls = np.array([k for k, (i, _) in enumerate(held) if i is None], "<i4").tobytes()
            counts = np.array([len(raw) // 2 for _, raw in held], "<i4").tobytes()
            row = {"shard": shard, "block": number, "before": before, "n_ids": size, "doc_ids": names, "null_ids": nulls, "counts": counts, "bits": bits, "payload": payload}
            number, before, held, size = number + 1, before + size, [], 0
            return pa.RecordBatch.from_pylist([row], schema=block_schema)

        block_schema = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("before", pa.int64()), ("n_ids", pa.int64()), *((n, pa.binary()) for n in ("doc_ids", "null_ids", "counts", "bits", "payload"))])
        for batch in batches:
            for i, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.append((i, raw))
                size += len(raw) // 2
                if size >= block_ids:
                    yield flush()
        if held:
            yield flush()

    keyed = ids.withColumn("salt", F.xxhash64("ids"))
    ordered = keyed.repartitionByRange("doc_id", "salt").sortWithinPartitions("doc_id", "salt").select("doc_id", "ids")
    ordered.mapInArrow(scratch.tidy(run), BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")
    scratch.discard(ids)


def read_token_files(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Decode files: doc_id, start (ids of all documents before), n_tokens, ids_crc32 (of the ids as little-endian uint32) and, if wanted, ids (array).

    Blocks are decoded where they are read: nothing is shuffled.
    """
    book = spark.read.parquet(f"{path}/codebook").collect()  # at most one row for each id of the vocabulary
    lengths = np.zeros(65_536, np.int64)
    for r in book:
        lengths[r["symbol"]] = r["bits"]
    symbol, length = decoding_table(lengths)
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")

    # A row for each writing task reaches the driver; a task writes hundreds of blocks.
    totals = sorted((r["shard"], r["n"]) for r in blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect())
    before, seen = {}, 0
    for shard, n in totals:
        before[shard] = seen
        seen += n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                counts = np.frombuffer(row["counts"], "<i4").astype(np.int64)
                names = np.frombuffer(row["doc_ids"], "<i8")
                nulls = np.zeros(len(names), bool)
                nulls[np.frombuffer(row["null_ids"], "<i4")] = True
                ids = decode_block(row["bits"], row["payload"], int(counts.sum()), symbol, length)
                ends = np.cumsum(counts)
                wide = ids.astype("<u4").tobytes()
                crc = [zlib.crc32(wide[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
                start = ends - counts + before[row["shard"]] + row["before"]
                columns = {"doc_id": pa.array(names, mask=nulls), "start": pa.array(start), "n_tokens": pa.array(counts), "ids_crc32": pa.array(crc, pa.int64())}
                if with_ids:
                    columns["ids"] = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_pydict(columns)

    return blocks.mapInArrow(scratch.tidy(run), "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)
