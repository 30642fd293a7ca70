import os

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector

from tidemill.operators import learners as L
from tidemill.plans import registry

DATA = "/root/testdata/sf0.1"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the shared tables are not here")
def test_far_clouds_are_found_at_size(spark):
    """Here the library's own start put two components into one cloud."""
    got = registry.QUERIES["clouds_gaussian_mixture"](spark, DATA)
    assert got.where("first <> idx % 3").count() == 0 and got.count() == 100_000


def test_a_step_of_the_mixture_by_hand(spark):
    """Overlapping values in one dimension: weights, means and variances of one step from the k-means start."""
    from tidemill.operators.mixture import fit_mixture

    x = np.concatenate([np.linspace(0, 4, 41), np.linspace(3, 9, 25)])
    df = spark.createDataFrame([([float(v)],) for v in x], "a array<double>").repartition(3).select(array_to_vector("a").alias("features"))
    centers = sorted(c[0] for c in L.build_estimator(L.KMeans(k=2, seed=1))[0].fit(df).clusterCenters())
    near = np.abs(x[:, None] - np.array(centers)).argmin(axis=1)
    start = [(np.mean(near == k), x[near == k].mean(), x[near == k].var()) for k in (0, 1)]
    p = np.array([w * np.exp(-((x - m) ** 2) / 2 / v) / np.sqrt(2 * np.pi * v) for w, m, v in start])
    r = p / p.sum(axis=0)
    model = fit_mixture(L.build_estimator(L.GaussianMixture(k=2, max_iteration=1, seed=1))[0], df)
    got = sorted(zip((g.mean[0] for g in model.gaussians), model.weights, (g.cov.toArray()[0, 0] for g in model.gaussians), strict=True))
    for k in (0, 1):
        m = (r[k] * x).sum() / r[k].sum()
        assert got[k] == pytest.approx((m, r[k].mean(), (r[k] * (x - m) ** 2).sum() / r[k].sum()))
