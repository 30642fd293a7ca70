import os
import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemill.llm import bpe, packing, scratch, token_output

VOCAB = public_tokenizers.path("byte_bpe_50k.json")
LIB = Tokenizer.from_file(VOCAB)
PARTS = st.sampled_from([" ", "\n", "a", "the", " and", "'s", "é", "ß", "²", "\t", " ", "\x1c", "\x00", "\x01", ".", "!!", ",", "<|endoftext|>", "中", "_", "12", "word,"])


def ids(text):
    return LIB.encode(text or "", add_special_tokens=False).ids


def crc(x):
    return zlib.crc32(np.array(x, "<u4").tobytes())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(PARTS, max_size=12).map("".join), max_size=6))
def test_cached_tokenizer_equals_library(texts):
    assert bpe.tokenizer(VOCAB).encode(texts) == [np.array(ids(t), "<u2").tobytes() for t in texts]


def test_cached_tokenizer_in_a_table_of_fixed_size(monkeypatch):
    rng = np.random.default_rng(3)
    tok = bpe.WordCachedTokenizer(VOCAB)
    tok._table = bpe.PieceTable(1 << 11, 1 << 11)
    monkeypatch.setattr(bpe, "RANGE_BYTES", 1_000)  # texts are looked up in parts
    size, emptied = tok._table.nbytes, 0
    for _ in range(12):
        texts = [" ".join("".join(rng.choice(["an", "th", "é", "on", ",", "ing", "\n", "x" * 300], rng.integers(1, 5))) for _ in range(60)) for _ in range(10)]
        before = tok._table.count
        assert tok.encode([*texts, "y" * 2_000, "a  " + "z" * 1_500 + " b"]) == [np.array(ids(t), "<u2").tobytes() for t in [*texts, "y" * 2_000, "a  " + "z" * 1_500 + " b"]]
        emptied += tok._table.count < before
        assert tok._table.nbytes == size and 2 * tok._table.count <= len(tok._table.keys)
    assert emptied
    assert bpe.PieceTable().nbytes < 32e6


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3000), min_size=1, max_size=400).map(lambda x: np.array(x) ** 2 % 50_000))
def test_huffman_round_trip(x):
    counts = np.bincount(x, minlength=65_536)
    lengths = token_output.code_lengths(counts)
    used = lengths[lengths > 0]
    assert lengths.max() <= 16 and (2.0**-used).sum() <= 1
    bits, payload = token_output.encode_block(x, token_output.canonical_codes(lengths), lengths)
    assert (token_output.decode_block(bits, payload, len(x), *token_output.decoding_table(lengths)) == x).all()


def test_code_lengths_reach_the_huffman_optimum():
    import heapq

    counts = np.array([50, 20, 9, 9, 5, 3, 2, 1, 1, 0])
    heap, total = [int(c) for c in counts if c], 0
    heapq.heapify(heap)
    while len(heap) > 1:
        a = heapq.heappop(heap) + heapq.heappop(heap)
        total += a
        heapq.heappush(heap, a)
    assert (token_output.code_lengths(counts) * counts).sum() == total


ROWS = [(1, "a b", "x"), (2, None, "x"), (3, "", "x"), (3, "", "x"), (None, "null id", "x"), (7, "word " * 3000, "y"), (9, "tie", "y"), (10, "tie", "y")]


def test_packing_is_whole_and_gapless(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, piece string")
    rows = packing.pack_documents(docs, VOCAB).collect()
    got = {}
    for r in rows:
        got.setdefault(r["doc_id"], []).append(r)
    for i, text, _ in ROWS:
        whole = [*ids(text), 2]
        pieces = sorted(got[i], key=lambda r: (r["piece"], r["sequence_id"]))
        if i == 3:
            assert len(pieces) == 2
            continue
        assert [p["piece"] for p in pieces] == list(range(len(pieces)))
        at = 0
        for p in pieces:
            assert p["start"] == at and p["ids_crc32"] == crc(whole[at : at + p["length"]])
            assert p["piece"] == 0 or p["length"] == 1024
            at += p["length"]
        assert at == len(whole)
    seqs = {}
    for r in rows:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 1024
    assert packing.pack_documents(docs.limit(0), VOCAB).count() == 0


def test_packing_is_close_to_the_volume_bound():
    rng = np.random.default_rng(5)
    lengths = (np.clip(rng.lognormal(6, 0.9, 20_000).astype(int), 1, None) - 1) % 1024 + 1
    plan = packing.plan_sequences(dict(zip(*[x.tolist() for x in np.unique(lengths, return_counts=True)], strict=True)))
    assert sum(n for _, n in plan) <= 1.002 * lengths.sum() / 1024 + 2
    assert sum(n * sum(c.values()) for c, n in plan) == len(lengths)


def test_dearest_filling_equals_search():
    from itertools import product

    rng = np.random.default_rng(8)
    for _ in range(60):
        lengths = sorted(rng.choice(np.arange(1, 15), 4, replace=False).tolist())
        left, room = [0] * 15, int(rng.integers(1, 30))
        for n in lengths:
            left[n] = int(rng.integers(0, 4))
        found = packing.dearest(room, lengths[::-1], left)
        assert all(0 < k <= left[n] for n, k in found.items())
        best = max(v for ks in product(*(range(left[n] + 1) for n in lengths)) if (v := sum(k * n for k, n in zip(ks, lengths, strict=True))) <= room)
        assert sum(n * k for n, k in found.items()) == best


def fewest(pieces, capacity):
    """Exact bin packing by search."""
    best = len(pieces)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(pieces):
            best = len(rooms)
            return
        for r in sorted(set(rooms)):
            if r >= pieces[i]:
                rest = [*rooms]
                rest[rest.index(r)] -= pieces[i]
                place(i + 1, rest)
        place(i + 1, [*rooms, capacity - pieces[i]])

    place(0, [])
    return best


def test_plans_against_exact_packing_and_best_fit():
    rng = np.random.default_rng(6)
    exact = 0
    for _ in range(80):
        pieces = sorted(rng.integers(1, 20, rng.integers(1, 10)).tolist(), reverse=True)
        counts = np.bincount(pieces, minlength=21)
        n = sum(m for _, m in packing.plan_sequences({k: int(v) for k, v in enumerate(counts) if v}, 20))
        assert fewest(pieces, 20) <= n <= sum(m for _, m in packing.best_fit(counts.copy(), 20))
        exact += n == fewest(pieces, 20)
    assert exact == 80
    for high in (300, 700, 1024):
        counts = np.bincount(rng.integers(1, high + 1, 3_000), minlength=1025)
        n = sum(m for _, m in packing.plan_sequences({k: int(v) for k, v in enumerate(counts) if v}))
        bound = -(-int(counts @ np.arange(1025)) // 1024)
        assert n <= sum(m for _, m in packing.best_fit(counts.copy(), 1024))
        assert high == 1024 or n <= bound + 2  # of lengths up to the capacity many have no partner
    assert packing.plan_sequences({}) == []


def test_rows_of_one_doc_id_over_many_shards(spark, tmp_path):
    docs = spark.createDataFrame([(5 if i % 3 else None, f"text {i % 40} " * (i % 7)) for i in range(300)] + [(1, "first"), (9, "last")], "doc_id long, text string").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        token_output.write_token_files(docs, f"file://{tmp_path}/t", VOCAB, block_ids=50)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert spark.read.parquet(f"file://{tmp_path}/t/blocks").select("shard").distinct().count() > 3
    rows = sorted(token_output.read_token_files(spark, f"file://{tmp_path}/t").collect(), key=lambda r: r["start"])
    at = 0
    for r in rows:
        assert r["start"] == at and r["n_tokens"] == len(r["ids"]) and r["ids_crc32"] == crc(r["ids"])
        at += r["n_tokens"]
    assert [r["doc_id"] for r in rows] == [None] * 100 + [1] + [5] * 200 + [9]
    texts = sorted(tuple(r["ids"]) for r in rows)
    assert texts == sorted(tuple([*ids(r["text"]), 0]) for r in docs.collect())


def test_token_files_round_trip(spark, tmp_path):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, start string")
    token_output.write_token_files(docs, f"file://{tmp_path}/t", VOCAB, block_ids=500)
    rows = sorted(token_output.read_token_files(spark, f"file://{tmp_path}/t").collect(), key=lambda r: r["start"])
    want = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0))
    at = 0
    for r, (i, text, _) in zip(rows, want, strict=True):
        whole = [*ids(text), 0]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids"], r["ids_crc32"]) == (i, at, len(whole), whole, crc(whole))
        at += len(whole)
    token_output.write_token_files(docs.limit(0), f"file://{tmp_path}/e", VOCAB)
    assert token_output.read_token_files(spark, f"file://{tmp_path}/e").count() == 0


def test_token_files_leave_no_intermediate_ids_and_move_no_payload(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i} " * (i % 9)) for i in range(200)], "doc_id long, text string").repartition(3)
    root = scratch.shared_root(spark).removeprefix("file://") + "/tidemill"
    there = set(os.listdir(root)) if os.path.isdir(root) else set()
    token_output.write_token_files(docs, f"file://{tmp_path}/t", VOCAB, block_ids=50)
    assert set(os.listdir(root)) == there
    found = token_output.read_token_files(spark, f"file://{tmp_path}/t", with_ids=False)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    blocks = spark.read.parquet(f"file://{tmp_path}/t/blocks").orderBy("shard", "block").collect()
    assert len(blocks) > 3 and [b["n_ids"] for b in blocks] == [int(np.frombuffer(b["counts"], "<i4").sum()) for b in blocks]
    for a, b in zip(blocks, blocks[1:], strict=False):
        assert b["before"] == (a["before"] + a["n_ids"] if a["shard"] == b["shard"] else 0)
    at = 0
    for r in sorted(found.collect(), key=lambda r: r["doc_id"]):
        want = [*ids(f"text {r['doc_id']} " * (r["doc_id"] % 9)), 0]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(want), crc(want))
        at += len(want)
