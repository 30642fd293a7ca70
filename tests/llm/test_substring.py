import hashlib
import random
import re

from tidemill.llm import substring_dedup


def plain(rows, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    least = {}
    for (i, _), w in zip(rows, words, strict=True):
        if i is not None:
            for k in range(len(w) - window + 1):
                key = tuple(w[k : k + window])
                least[key] = min(i, least.get(key, i))
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = set()
        for k in range(len(w) - window + 1):
            if i is not None and least[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "bé", "The", "of,", "x.", "\x1cq", "zz"]) + rng.choice(["", "1", "2", "ß"])
    shared = [[word() for _ in range(rng.randint(3, 60))] for _ in range(6)]
    rows = []
    for i in rng.sample(range(1000), 70):
        parts = [[word() for _ in range(rng.randint(0, 30))]]
        for _ in range(rng.randint(0, 4)):
            part = list(rng.choice(shared))
            if rng.random() < 0.4:
                part[rng.randrange(len(part))] = word()
            parts += [part, [word() for _ in range(rng.randint(0, 8))]]
        rows.append((i, rng.choice([" ", "\n", " \t"]).join(w for p in parts for w in p)))
    rows += [(2000, rows[0][1]), (2001, rows[0][1]), (2001, rows[0][1]), (2001, rows[3][1]), (None, rows[0][1]), (2002, None), (2003, ""), (2004, "again " * 500), (2005, "again " * 300), (-5, rows[1][1])]
    return rows


def test_rows_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "CHUNK_WORDS", 64)
    for seed, window, anchor in ((1, 8, 3), (2, 5, 5)):
        rows = rows_of(seed)
        df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, spans string")
        got = sorted((tuple(r) for r in substring_dedup.remove_repeats(df, window, anchor).collect()), key=str)
        assert got == plain(rows, window)
    assert substring_dedup.remove_repeats(df.limit(0)).count() == 0


def test_paths_compact_up_to_a_branch(spark):
    src = lambda start, n: (1, 5, start << 20 | n)
    path = "low long, content long, head long, tail long, src struct<doc_id: long, check: long, place: long>"
    line = [(1, 1, 10, 20, src(0, 4)), (2, 1, 20, 30, src(4, 3)), (3, 1, 30, 40, src(7, 2)), (4, 1, 60, 70, src(20, 2))]
    units = lambda rows: sorted((r.low, r.unit, r.off) for r in substring_dedup.compacted(spark.createDataFrame(rows, path)).where("source = 1").collect())
    assert units(line) == [(1, 0, 0), (2, 0, 4), (3, 0, 7), (4, 20, 0)]
    # Another text goes on differently after the second path: its end is a branching node.
    assert units([*line, (3, 2, 30, 50, (9, 5, 0))]) == [(1, 0, 0), (2, 0, 4), (3, 7, 0), (4, 20, 0)]


def test_spans_are_verified_by_words(spark):
    rows = [(1, "a b c d e"), (2, "x a b c d e"), (3, "a b c X e")]
    packed = substring_dedup._packed(spark.createDataFrame(rows, "doc_id long, text string"))
    check = {r.doc_id: r.check for r in packed.collect()}
    hits = [(2, check[2], 1, check[1], 0, 0, 1, 3), (3, check[3], 1, check[1], 0, 0, 0, 1), (3, check[3], 1, check[1], 0, 1, 1, 2), (2, check[2], 1, check[1], 0, 1, 2, 2)]
    hits = spark.createDataFrame(hits, "doc_id long, check long, source long, source_check long, unit long, off long, at long, n long")
    assert [(r.doc_id, r.at, r.n) for r in substring_dedup.differing(packed, hits, 3).collect()] == [(3, 1, 2)]
