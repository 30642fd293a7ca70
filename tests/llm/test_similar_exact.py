import random

import pytest

from tidemill.llm import simhash


def exact(a, b, n=5):
    def s(t):
        w = t.lower().split()
        return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))}

    a, b = s(a), s(b)
    return len(a & b) / len(a | b)


def exact_groups(rows):
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(rows):
        for j, b in rows[k + 1 :]:
            if find(i) != find(j) and exact(a, b) >= 0.8:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in root}


def groups(spark, rows):
    return {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def fresh(rng, n):
    return [f"w{rng.getrandbits(40):x}" for _ in range(n)]


def test_both_sides_of_the_threshold(spark):
    # pairs that share a head: k of its shingles are shared, each side has own ones
    rng, rows = random.Random(5), []
    for i in range(60):
        shared, own = (160, 18) if i % 2 else (150, 22)  # J = 156/192 = 0.8125 and 146/190 = 0.768
        head = fresh(rng, shared)
        rows += [(2 * i, " ".join(head + fresh(rng, own))), (2 * i + 1, " ".join(head + fresh(rng, own)))]
    got = groups(spark, rows)
    joined = [got[2 * i] == got[2 * i + 1] for i in range(60)]
    want = [exact(rows[2 * i][1], rows[2 * i + 1][1]) >= 0.8 for i in range(60)]
    assert sum(want) == 30 and not any(j for j, w in zip(joined, want, strict=True) if not w)
    assert sum(joined) >= 28


def test_repeated_lines_count_once(spark):
    rng = random.Random(6)
    line = fresh(rng, 9)
    rows = [(i, " ".join(fresh(rng, 54) + line * 20)) for i in range(20)]
    assert groups(spark, rows) == {i: i for i, _ in rows}
    assert simhash.sketch("a b c d e f g " * 30, 5) == simhash.sketch("a b c d e f g " * 3, 5)
    # one text and the same with its line repeated have almost the same set
    body = fresh(rng, 200)
    got = groups(spark, [(1, " ".join(body + line)), (2, " ".join(body + line * 30))])
    assert got == {1: 1, 2: 1}


def test_short_texts(spark):
    rng, rows = random.Random(7), []
    for i in range(40):
        words = fresh(rng, 9)  # 5 shingles, and 4 of them
        rows += [(10 * i, " ".join(words)), (10 * i + 1, " ".join(words[:8])), (10 * i + 2, " ".join(words[:7])), (10 * i + 3, words[0])]
    got, want = groups(spark, rows), exact_groups(rows)
    assert sum(got[i] == want[i] for i in got) >= 0.97 * len(got)
    assert all(got[10 * i + 2] == 10 * i + 2 and got[10 * i + 3] == 10 * i + 3 for i in range(40))


@pytest.mark.parametrize(("small", "block"), [(2, 16), (32, 256)])
def test_large_families_equal_all_pairs(monkeypatch, spark, small, block):
    # copies of two bases, many at the edge of the threshold from each other: components must be those of all pairs
    monkeypatch.setattr(simhash, "SMALL_GROUP", small)
    monkeypatch.setattr(simhash, "BLOCK_DOCUMENTS", block)
    rng, rows = random.Random(8), []
    for b in range(2):
        base = fresh(rng, 150)
        for c in range(60):
            copy = list(base)
            for at in rng.sample(range(150), rng.choice([0, 1, 2, 3, 4, 5])):
                copy[at] = fresh(rng, 1)[0]
            rows.append((100 * b + c, " ".join(copy)))
    got, want = groups(spark, rows), exact_groups(rows)
    assert len(set(want.values())) > 2 and got == want
