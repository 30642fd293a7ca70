import random

import corpus_pipeline
from tidemill.llm import secrets_scan, simhash


def jaccard(a, b, n=5):
    def s(t):
        w = t.lower().split()
        return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))}

    a, b = s(a), s(b)
    return len(a & b) / len(a | b)


def near_copies(seed, n):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices(["an", "the", "on", "er", "ing", "ti", "wh", "es"], k=rng.randint(2, 4)))
    rows, bases = [], {}
    for i in range(n):
        words = [word() for _ in range(rng.randint(80, 300))]
        rows.append((10 * i, " ".join(words)))
        bases[10 * i] = [10 * i]
        for c in range(rng.choice([0, 0, 1, 3])):
            copy = list(words)
            for _ in range(rng.randint(0, len(copy) // 60)):
                copy[rng.randrange(len(copy))] = word()
            rows.append((10 * i + 1 + c, " ".join(copy)))
            bases[10 * i].append(10 * i + 1 + c)
    return rows, bases


def test_similar_documents_against_all_pairs(spark):
    rows, _ = near_copies(1, 60)
    rows += [(5000, None), (5001, ""), (None, rows[0][1]), (0, rows[0][1])]
    text = {i: t or "" for i, t in rows if i is not None}
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    ids = sorted(text)
    close = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if jaccard(text[a], text[b]) >= 0.8]
    assert sum(got[a] == got[b] for a, b in close) >= 0.97 * len(close)
    far = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if got[a] == got[b] and a // 10 != b // 10 and a < 5000]
    assert far == [] and got[5001] == 5000


def test_large_group_links(monkeypatch, spark):
    monkeypatch.setattr(simhash, "SMALL_GROUP", 2)
    rows, bases = near_copies(2, 25)
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    text = dict(rows)
    close = [(a, b) for v in bases.values() for a in v for b in v if a < b and jaccard(text[a], text[b]) >= 0.8]
    assert sum(got[a] == got[b] for a, b in close) >= 0.9 * len(close)


def test_stages_end_to_end(spark, tmp_path):
    rng = random.Random(3)
    rows, bases = near_copies(4, 40)
    item = "one two three four five six seven eight nine ten eleven twelve"
    docs = [(i, t, "en", "s", len(t)) for i, t in rows]
    docs += [(7000, f"{rows[0][1][:200]} {item} tail", "en", "s", 1), (7001, "password = abcDEF123456789 " + " ".join(rng.choices(["an", "on", "er"], k=40)), "en", "s", 1), (7002, None, None, None, None), (None, "no id", "en", "s", 5)]
    toxic = [(8000 + i, " ".join(rng.choices(["the", "an", "on", "grumbly", "snarfish"], k=60)) + f" {i}", "en", "s", 1) for i in range(40)]
    docs += toxic
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i >= 8000)) for i, *_ in docs if i is not None], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    d = f"file://{tmp_path}"
    frame = spark.read.parquet(f"{d}/documents.parquet")
    columns, counts = frame.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, frame, d)
        if k < 4:
            assert out.columns == columns, name
        out.write.parquet(f"{d}/{k}")
        frame = spark.read.parquet(f"{d}/{k}")
        counts.append(frame.select("doc_id").distinct().count())
        if name == "toxicity":
            left = {r["doc_id"] for r in frame.collect()}
            assert not left & {t[0] for t in toxic} and None in left and len(left) >= len(docs) - 42
        if name == "simhash_near_dedup":
            left = {r["doc_id"] for r in frame.collect()}
            assert {7001, 7002, None} | set(bases) <= left | {7000}
        if name == "secret_scans":
            texts = {r["doc_id"]: r["text"] for r in frame.collect()}
            assert 7000 not in texts and "abcDEF123456789" not in texts[7001] and texts[7002] is None
            assert all(r["n_chars"] is None or r["n_chars"] == len(r["text"]) for r in frame.collect())
            assert not any(secrets_scan.scan(t) for t in texts.values())
    assert counts[3] == counts[4]
