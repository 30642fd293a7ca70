"""Gaussian mixtures by expectation and maximization, started from k-means over all rows.

The library's fit starts from means of a few random rows each, which all lie near the common mean: two components then
may end in one cloud and one over two. Here the start is a k-means clustering. Sums come to the driver by partition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import GaussianMixture, GaussianMixtureModel, KMeans
from pyspark.ml.common import _py2java
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseMatrix, Vectors
from pyspark.sql import DataFrame

from tidemill.session import ship_package

Parts = list[tuple[float, np.ndarray, np.ndarray]]  # weight, mean and covariance of each component


def log_densities(x: np.ndarray, parts: Parts) -> np.ndarray:
    """Rows by components: the logarithm of weight times density; directions without variance do not count."""
    out = np.empty((len(x), len(parts)))
    for k, (weight, mean, cov) in enumerate(parts):
        values, axes = np.linalg.eigh(cov)
        kept = values > np.finfo(float).eps * len(values) * max(values.max(), 0.0)
        z = (x - mean) @ (axes[:, kept] / np.sqrt(values[kept]))
        out[:, k] = np.log(weight) - 0.5 * ((z * z).sum(axis=1) + np.log(values[kept]).sum() + len(mean) * np.log(2 * np.pi))
    return out


def _sums(rows: DataFrame, means: list[np.ndarray], shares: Callable[[np.ndarray], tuple[np.ndarray, float]]) -> tuple[Parts, float]:
    """The components that the rows' shares give, and the log-likelihood. Deviations are summed from ``means``, so little cancels."""
    k, d = len(means), len(means[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 + k * (1 + d + d * d))
        for batch in batches:
            if not len(batch):
                continue
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), d)
            r, likelihood = shares(x)
            total[0] += likelihood
            for j, at in enumerate(range(1, len(total), 1 + d + d * d)):
                y, w = x - means[j], r[:, j]
                total[at] += w.sum()
                total[at + 1 : at + 1 + d] += w @ y
                total[at + 1 + d : at + 1 + d + d * d] += ((y * w[:, None]).T @ y).ravel()
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["s"])

    total = np.sum([r["s"] for r in rows.mapInArrow(run, "s array<double>").collect()], axis=0)
    found = []
    for j, s in enumerate(total[1:].reshape(k, -1)):
        if s[0] > 0:
            off = s[1 : 1 + d] / s[0]
            found.append((s[0], means[j] + off, s[1 + d :].reshape(d, d) / s[0] - np.outer(off, off)))
    n = sum(w for w, *_ in found)
    return [(w / n, m, c) for w, m, c in found], float(total[0])


def fit_mixture(estimator: GaussianMixture, df: DataFrame) -> GaussianMixtureModel:
    """The estimator's model, of its k, iterations, tolerance and seed; fewer components where there are fewer different rows."""
    ship_package(df.sparkSession)
    column = estimator.getFeaturesCol()
    centers = KMeans(k=estimator.getK(), maxIter=5, seed=estimator.getSeed(), featuresCol=column).fit(df).clusterCenters()
    rows = df.select(vector_to_array(column).alias("x"))

    def nearest(x: np.ndarray) -> tuple[np.ndarray, float]:
        return np.eye(len(centers))[((x[:, None, :] - np.array(centers)) ** 2).sum(axis=2).argmin(axis=1)], 0.0

    parts, _ = _sums(rows, centers, nearest)
    before = -np.inf
    for _ in range(estimator.getMaxIter()):

        def shares(x: np.ndarray, parts=parts) -> tuple[np.ndarray, float]:
            logs = log_densities(x, parts)
            most = logs.max(axis=1, keepdims=True)
            r = np.exp(logs - most)
            each = r.sum(axis=1, keepdims=True)
            return r / each, float((most + np.log(each)).sum())

        parts, likelihood = _sums(rows, [m for _, m, _ in parts], shares)
        if abs(likelihood - before) < estimator.getTol():
            break
        before = likelihood
    return _model(estimator, parts, df)


def _model(estimator: GaussianMixture, parts: Parts, df: DataFrame) -> GaussianMixtureModel:
    sc = df.sparkSession.sparkContext
    gaussian = sc._jvm.org.apache.spark.ml.stat.distribution.MultivariateGaussian
    weights, gaussians = sc._gateway.new_array(sc._jvm.double, len(parts)), sc._gateway.new_array(gaussian, len(parts))
    for k, (weight, mean, cov) in enumerate(parts):
        weights[k] = float(weight)
        gaussians[k] = gaussian(_py2java(sc, Vectors.dense(mean)), _py2java(sc, DenseMatrix(len(mean), len(mean), cov.ravel(order="F").tolist())))
    java = sc._jvm.org.apache.spark.ml.clustering.GaussianMixtureModel(estimator.uid, weights, gaussians)
    java.setFeaturesCol(estimator.getFeaturesCol())
    return GaussianMixtureModel(java)
