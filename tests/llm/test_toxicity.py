import random
import zlib

import numpy as np

from tidemill.llm import toxicity


def plain_score(model, text):
    """Every n-gram of every word, one by one."""
    mask = (1 << 64) - 1
    m = int(toxicity._MULTIPLIER)
    values = []
    for w in (text or "").lower().encode().split():
        w = b" " + w + b" "
        for n in toxicity.NGRAMS:
            for i in range(len(w) - n + 1):
                h = 0
                for c in w[i : i + n]:
                    h = (h * m + c + 1) & mask
                h ^= h >> 29
                values.append(model.table[((h + n) * m & mask) >> (64 - toxicity.BUCKET_BITS)])
    logit = (toxicity.SCALE * float(np.mean(values)) if values else 0.0) + model.bias
    return 1 / (1 + np.exp(-logit))


def corpus(n, seed):
    rng = random.Random(seed)
    bad = ["grumbly", "snarfish", "blortful"]
    texts, labels = [], []
    for _ in range(n):
        words = ["".join(rng.choices(["an", "the", "on", "er", "ing", "ti"], k=rng.randint(1, 4))) for _ in range(rng.randint(5, 80))]
        toxic = rng.random() < 0.3
        for _ in range(3 * toxic):
            words[rng.randrange(len(words))] = rng.choice(bad)
        texts.append(" ".join(words))
        labels.append(int(toxic))
    return texts, labels


def test_scores_equal_plain_form_across_slices(monkeypatch):
    texts, labels = corpus(60, 1)
    model = toxicity.train(texts, labels, epochs=2)
    odd = [None, "", " \n", "a", "É " * 30, "word " * 400, texts[0], texts[0], "x" * 5000]
    monkeypatch.setattr(toxicity, "SLICE_BYTES", 300)
    got = model.scores(odd)
    assert np.allclose(got, [plain_score(model, t) for t in odd])


def test_learns_and_reaches_misspellings():
    model = toxicity.train(*corpus(500, 2))
    texts, labels = corpus(300, 3)
    got = model.scores(texts) >= 0.5
    assert (got == np.array(labels)).mean() > 0.97
    clean = "an ontheing er tiering the an on " * 3
    assert model.scores([clean + "snarfissh grumblyy blortfull"])[0] > 0.5 > model.scores([clean])[0]


def test_query_rows(spark):
    texts, labels = corpus(200, 4)
    docs = spark.createDataFrame([(i, t, 0.5) for i, t in enumerate(texts)] + [(None, "x", 0.5), (500, None, 0.5)], "doc_id long, text string, score double")
    lab = spark.createDataFrame([*((i, 1, y) for i, y in enumerate(labels)), (None, 1, 1), (3, 1, None), (999, 1, 1)], "doc_id long, quality int, toxic int")
    rows = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, lab)).collect()
    assert len(rows) == 202
    for r in rows:
        assert r["held_out"] == (r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
    held = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] is not None]
    assert sum(a == b for a, b in held) / len(held) > 0.8
    # labels of the held-out fold are never read
    flipped = spark.createDataFrame([(i, 1, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in enumerate(labels)], "doc_id long, quality int, toxic int")
    again = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, flipped)).collect()}
    assert again == {r["doc_id"]: r["score"] for r in rows}
    empty = toxicity.fit_toxicity(docs, lab.limit(0))
    assert toxicity.score_toxicity(docs.limit(0), empty).count() == 0
    assert toxicity.keep_clean(docs, empty).columns == docs.columns
