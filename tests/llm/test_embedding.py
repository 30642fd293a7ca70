import numpy as np
import pytest

from tidemill.llm import embedding_dedup


def plain(rows, threshold=0.95):
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    n = len(rows)
    unit = [np.array(v, float) / np.linalg.norm(v) if k else None for k, (_, v) in zip(ok, rows, strict=True)]
    near = [[j for j in range(n) if j != i and ok[i] and ok[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold] for i in range(n)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        c = min(ids, default=None)
        out.append((rows[i][0], len(near[i]), c, rows[i][0] is not None and rows[i][0] == c))
    return sorted(out, key=str)


def rows_of(n, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.5:
            v = np.array(rows[rng.integers(len(rows))][1]) + rng.standard_normal(16) * rng.choice([0, 0.01, 0.05, 0.08])
        else:
            v = rng.standard_normal(16)
        rows.append((i, [float(np.float32(x)) for x in v]))
    return rows


@pytest.mark.parametrize("block", [2_048, 16])
def test_rows_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK_VECTORS", block)
    rows = rows_of(300, 1)
    rows += [(900, rows[0][1]), (900, rows[0][1]), (None, rows[5][1]), (901, None), (902, []), (903, [0.0] * 16), (904, [1.0] * 15 + [float("nan")]), (905, [1.0] * 15 + [float("inf")]), (906, [1.0] * 15 + [None]), (907, [1.0, 2.0, 3.0]), (908, [2.0, 4.0, 6.0]), (None, None)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, kept int")
    got = sorted((tuple(r) for r in embedding_dedup.near_vectors(df).collect()), key=str)
    want = plain(rows)
    assert sum(g[1] for g in got) >= 0.99 * sum(w[1] for w in want)
    same = sum(a == b for a, b in zip(got, want, strict=True))
    assert same >= 0.97 * len(want)
    for g, w in zip(got, want, strict=True):
        assert g[1] <= w[1]
    if block == 16:
        assert embedding_dedup.near_vectors(df.limit(0)).count() == 0


def test_traversal_is_in_order_of_summed_distance():
    rng = np.random.default_rng(2)
    x, books = rng.standard_normal((50, 8)), (rng.standard_normal((7, 4)), rng.standard_normal((7, 4)))
    total = embedding_dedup.squared_distances(x[:, :4], books[0])[:, :, None] + embedding_dedup.squared_distances(x[:, 4:], books[1])[:, None, :]
    want = np.argsort(total.reshape(50, -1), axis=1)[:, :9]
    assert (embedding_dedup.nearest_cells(x, books, 9) == want).all()


def test_links_of_production_shape(spark):
    rng = np.random.default_rng(7)
    x = rng.standard_normal((1_500, 64))
    noise = rng.standard_normal((1_500, 64))
    x = np.concatenate([x, x / np.linalg.norm(x, axis=1)[:, None] + rng.uniform(0, 0.4, (1_500, 1)) * noise / np.linalg.norm(noise, axis=1)[:, None]]).astype(np.float32)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>")
    got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.near_vectors(df).collect()}
    y = x.astype(float)
    y /= np.linalg.norm(y, axis=1)[:, None]
    want = (y @ y.T >= 0.95).sum(1) - 1
    assert want.sum() > 1_500 and all(got[i] <= n for i, n in enumerate(want.tolist()))
    assert sum(got.values()) >= 0.99 * want.sum()


def test_calibration_meets_its_target_or_says_so(monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((400, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    books = (embedding_dedup.codebook(x[:, :16], 40, 1), embedding_dedup.codebook(x[:, 16:], 40, 2))
    cells, recall = embedding_dedup.calibrate(x, books, 0.6, 0.99)
    assert cells > 1 and recall >= 0.99
    monkeypatch.setattr(embedding_dedup, "MOST_CELLS", 1)
    with pytest.raises(ValueError, match="under the target"):
        embedding_dedup.calibrate(x, books, 0.6, 0.99)
