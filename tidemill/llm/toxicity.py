"""Toxicity by subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A text is the bag of the character n-grams (bytes, word ends included) of its lower-cased words, hashed into buckets.
Each bucket has a vector; a text's vectors are averaged and a linear softmax over two classes reads the average. An
unseen misspelling shares most n-grams, and so most of its vector, with the word it stands for.

Only the difference of the two output weights matters to the softmax, so the gradient of a bucket's vector is that
difference times one number, the sum over texts of error times share. Vectors and output weights are updated
together from these numbers.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm import scratch

NGRAMS = (3, 4, 5, 6)
BUCKET_BITS = 18
DIMENSIONS = 8
EPOCHS = 12
BATCH = 32
RATE = 0.05
#: A bounded sample of labelled rows is learned from: this many at most, those of the smallest hash of doc_id.
SAMPLE_ROWS = 6_000
SCALE = 100.0  # texts are long: a few telling words are a small part of the average
SLICE_BYTES = 1 << 17
BATCH_ROWS = 256
FOLDS, HELD_OUT = 5, 0

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def normalized(text: str | None) -> bytes:
    """Lower-cased words, each between single spaces."""
    words = (text or "").lower().encode("utf-8", "surrogatepass").split()
    return b" " + b" ".join(words) + b" " if words else b" "


def ngram_buckets(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(position, bucket) of every n-gram that lies within one word and the spaces at its ends."""
    x = np.frombuffer(data, np.uint8)
    space = x == 32
    word = np.cumsum(space, dtype=np.int32)  # a space belongs to the word after it
    code = x.astype(np.uint64) + np.uint64(1)
    h = np.zeros(len(x), np.uint64)
    at, buckets = [], []
    for n in range(1, max(NGRAMS) + 1):
        m = len(x) - n + 1
        if m <= 0:
            break
        with np.errstate(over="ignore"):
            h = (h[:m] * _MULTIPLIER) + code[n - 1 :]
        if n in NGRAMS:
            # No space strictly inside: the words at both ends agree, or the last byte is the space that ends it.
            inside = word[: m] == word[n - 2 : n - 2 + m]
            p = np.flatnonzero(inside)
            mixed = h[p] ^ (h[p] >> np.uint64(29))
            with np.errstate(over="ignore"):
                mixed = (mixed + np.uint64(n)) * _MULTIPLIER
            at.append(p)
            buckets.append((mixed >> np.uint64(64 - BUCKET_BITS)).astype(np.int64))
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *at]), np.concatenate([none, *buckets])


@dataclass(frozen=True)
class ToxicityModel:
    """``table``: each bucket's vector times the difference of the output weights; ``bias``: the difference of the biases."""

    table: np.ndarray
    bias: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Probabilities of label 1. Whole texts, joined into runs of bounded size; a text without words has the bias alone."""
        data = [normalized(t) for t in texts]
        total, count = np.zeros(len(data)), np.zeros(len(data))
        i = 0
        while i < len(data):
            if len(data[i]) > SLICE_BYTES:
                for part in _slices(data[i]):
                    _, b = ngram_buckets(part)
                    total[i] += self.table[b].sum()
                    count[i] += len(b)
                i += 1
                continue
            j, size = i, 0
            while j < len(data) and size + len(data[j]) <= SLICE_BYTES:
                size += len(data[j])
                j += 1
            ends = np.cumsum([len(d) for d in data[i:j]])
            at, b = ngram_buckets(b"".join(data[i:j]))
            doc = i + np.searchsorted(ends, at, "right")
            total += np.bincount(doc, self.table[b], len(data))
            count += np.bincount(doc, minlength=len(data))
            i = j
        logit = SCALE * total / np.maximum(count, 1) + self.bias
        return 1 / (1 + np.exp(-np.clip(logit, -50, 50)))


def _slices(data: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(data) - 1:
        end = min(at + SLICE_BYTES, len(data))
        if end < len(data):
            cut = data.rfind(b" ", at + 1, end)
            end = (cut if cut > at else data.find(b" ", end)) + 1
        yield data[at:end]
        at = end - 1  # the space between two words ends one and begins the other


def train(texts: list[str | None], labels: list[int], seed: int = 7, epochs: int = EPOCHS, rate: float = RATE) -> ToxicityModel:
    """Learn from whole texts. With one class the score is that class's share everywhere, and with no rows a quarter: nothing speaks for label 1."""
    y = np.array(labels, float)
    size = 1 << BUCKET_BITS
    share = (y.sum() + 0.5) / (len(y) + 2 - (len(y) > 0))
    bias = float(np.log(share / (1 - share)))
    if len(np.unique(y)) < 2:
        return ToxicityModel(np.zeros(size), bias)
    rows = []
    for t in texts:
        data = normalized(t)
        parts = [np.unique(ngram_buckets(p)[1], return_counts=True) for p in (_slices(data) if len(data) > SLICE_BYTES else [data])]
        b, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        rows.append((b.astype(np.int32), (SCALE * n / max(n.sum(), 1)).astype(np.float32)))
    rng = np.random.default_rng(seed)
    vectors = (rng.standard_normal((size, DIMENSIONS)) * 0.01).astype(np.float32)
    out = (rng.standard_normal(DIMENSIONS) / np.sqrt(DIMENSIONS)).astype(np.float32)
    seen_v, seen_o = np.full(size, 1e-3, np.float32), np.full(DIMENSIONS, 1e-3, np.float32)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for k in range(0, len(order), BATCH):
            batch = order[k : k + BATCH]
            cols = np.concatenate([rows[i][0] for i in batch])
            vals = np.concatenate([rows[i][1] for i in batch])
            doc = np.repeat(np.arange(len(batch)), [len(rows[i][0]) for i in batch])
            logit = bias + np.bincount(doc, vals * (vectors @ out)[cols], len(batch))
            error = 1 / (1 + np.exp(-np.clip(logit, -50, 50))) - y[batch]
            g = (np.bincount(cols, error[doc] * vals, size) / len(batch)).astype(np.float32)
            grad_out = g @ vectors
            seen_v += g * g
            vectors -= (rate * g / np.sqrt(seen_v))[:, None] * out
            seen_o += grad_out * grad_out
            out = out - rate * grad_out / np.sqrt(seen_o)
            bias -= rate * float(error.mean())
    return ToxicityModel((vectors @ out).astype(np.float64), bias)


def in_held_out(doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo the number of folds; a null id is held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(True))


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> ToxicityModel:
    """Train on at most ``sample_rows`` labelled documents outside the held-out fold.

    Rows with a null id, label or text teach nothing; an id labelled twice is taken with its larger label.
    """
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where("doc_id IS NOT NULL AND toxic IS NOT NULL")
        .where(~in_held_out())
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample_rows)
    )
    # At most sample_rows ids and labels: a proven bound for the broadcast.
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    sample = ids.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic").toArrow().sort_by([("doc_id", "ascending"), ("text", "ascending")])
    return train(sample["text"].to_pylist(), sample["toxic"].to_pylist())


def _scored(model: ToxicityModel, texts: pa.Array) -> np.ndarray:
    """Scores of a column, a few hundred texts in memory at a time."""
    parts = [model.scores(texts.slice(k, BATCH_ROWS).to_pylist()) for k in range(0, len(texts), BATCH_ROWS)]
    return np.concatenate([np.zeros(0), *parts])


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs`` (doc_id, text).

    Null and empty texts get the score of a text without words. Repeated rows give repeated results; other columns are
    ignored.
    """
    spark = scratch.prepare(docs)
    shared = spark.sparkContext.broadcast(model)  # of fixed size: one number a bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = _scored(shared.value, batch.column(1))
            held = [i is None or zlib.crc32(str(i).encode()) % FOLDS == HELD_OUT for i in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held, pa.bool_()), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(scratch.tidy(run), "doc_id long, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """The rows of ``docs`` whose text scores under 0.5, all columns as they are."""
    spark = scratch.prepare(docs)
    shared = spark.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_scored(shared.value, batch.column(at)) < 0.5))

    return docs.mapInArrow(scratch.tidy(run), docs.schema)
