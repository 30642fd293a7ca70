"""Model specs and the estimators they stand for.

A spec's field is unset (``None``: the estimator's default), a value, or a ``Grid`` of values to search.
"""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from itertools import product
from typing import Any

from pyspark.ml import Estimator
from pyspark.ml import classification as C
from pyspark.ml import clustering as K
from pyspark.ml import regression as R
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.ml.functions import vector_to_array

from tidemill.errors import TidemillError
from tidemill.functions.vectors import argmax


@dataclass(frozen=True)
class Grid:
    values: tuple

    def __init__(self, *values: Any):
        object.__setattr__(self, "values", tuple(values[0]) if len(values) == 1 and isinstance(values[0], (list, tuple)) else values)


@dataclass(frozen=True)
class Spec:
    """Base of all specs. ``id``, ``name``, ``created_by`` and ``created_at`` are for bookkeeping only."""

    id: str | None = field(default=None, kw_only=True)
    name: str | None = field(default=None, kw_only=True)
    created_by: str | None = field(default=None, kw_only=True)
    created_at: str | None = field(default=None, kw_only=True)

    #: field of the spec: param of the estimator, where they differ
    RENAMED = {"max_iteration": "maxIter", "regularization": "regParam", "tolerance": "tol", "elastic_mixing_ratio": "elasticNetParam"}
    BOOKKEEPING = ("id", "name", "created_by", "created_at")

    def params(self) -> dict[str, Any]:
        out = {}
        for f in fields(self):
            v = getattr(self, f.name)
            if f.name in self.BOOKKEEPING or v is None:
                continue
            if isinstance(v, TreeCore):
                out |= v.params()
                continue
            first, *rest = f.name.split("_")
            out[self.RENAMED.get(f.name, first + "".join(x.capitalize() for x in rest))] = v
        return out


@dataclass(frozen=True)
class TreeCore:
    max_depth: Any = None
    max_bins: Any = None
    min_instances_per_node: Any = None
    min_info_gain: Any = None
    seed: int | None = None

    def params(self) -> dict[str, Any]:
        names = ("maxDepth", "maxBins", "minInstancesPerNode", "minInfoGain", "seed")
        return {n: v for n, v in zip(names, (self.max_depth, self.max_bins, self.min_instances_per_node, self.min_info_gain, self.seed), strict=True) if v is not None}


class Classifier(Spec):
    pass


class Regressor(Spec):
    pass


class Clusterer(Spec):
    pass


@dataclass(frozen=True)
class LogisticRegression(Classifier):
    aggregation_depth: Any = None
    elastic_mixing_ratio: Any = None
    family: str | None = None
    fit_intercept: bool | None = None
    max_iteration: Any = None
    regularization: Any = None
    threshold: Any = None
    thresholds: list[float] | None = None
    standardization: bool | None = None
    tolerance: Any = None


@dataclass(frozen=True)
class MultiLayerPerceptron(Classifier):
    hidden_layers: tuple[int, ...] = ()
    block_size: Any = None
    seed: int | None = None
    max_iteration: Any = None
    solver: str | None = None
    step_size: Any = None
    tolerance: Any = None


@dataclass(frozen=True)
class DecisionTree(Classifier):
    core: TreeCore = TreeCore()
    impurity: str | None = None


@dataclass(frozen=True)
class RandomForest(Classifier):
    num_trees: Any = None
    core: TreeCore = TreeCore()
    subsampling_rate: Any = None
    impurity: str | None = None
    feature_subset_strategy: str | None = None


@dataclass(frozen=True)
class GradientBoostTree(Classifier):
    loss_type: str | None = None
    max_iteration: Any = None
    step_size: Any = None
    core: TreeCore = TreeCore()
    subsampling_rate: Any = None


@dataclass(frozen=True)
class NaiveBayes(Classifier):
    smoothing: Any = None
    model_type: str | None = None


@dataclass(frozen=True)
class LinearSupportVectorMachine(Classifier):
    aggregation_depth: Any = None
    fit_intercept: bool | None = None
    max_iteration: Any = None
    regularization: Any = None
    standardization: bool | None = None
    threshold: Any = None
    tolerance: Any = None


@dataclass(frozen=True)
class LinearRegression(Regressor):
    aggregation_depth: Any = None
    elastic_mixing_ratio: Any = None
    solver: str | None = None
    fit_intercept: bool | None = None
    max_iteration: Any = None
    regularization: Any = None
    standardization: bool | None = None
    tolerance: Any = None


@dataclass(frozen=True)
class GeneralizedLinearRegression(Regressor):
    solver: str | None = None
    family: str | None = None
    fit_intercept: bool | None = None
    link: str | None = None
    max_iteration: Any = None
    regularization: Any = None
    tolerance: Any = None


@dataclass(frozen=True)
class RegressionTree(Regressor):
    core: TreeCore = TreeCore()
    impurity: str | None = None


@dataclass(frozen=True)
class RandomRegressionForest(Regressor):
    impurity: str | None = None
    num_trees: Any = None
    core: TreeCore = TreeCore()
    subsampling_rate: Any = None
    feature_subset_strategy: str | None = None


@dataclass(frozen=True)
class GradientBoostRegressionTree(Regressor):
    loss_type: str | None = None
    max_iteration: Any = None
    step_size: Any = None
    core: TreeCore = TreeCore()
    subsampling_rate: Any = None


@dataclass(frozen=True)
class KMeans(Clusterer):
    init_mode: str | None = None
    init_steps: int | None = None
    k: int | None = None
    max_iteration: int | None = None
    tolerance: float | None = None
    seed: int | None = None


@dataclass(frozen=True)
class LDA(Clusterer):
    checkpoint_interval: int | None = None
    keep_last_checkpoint: bool | None = None
    doc_concentration: list[float] | None = None
    optimize_doc_concentration: bool | None = None
    topic_concentration: float | None = None
    k: int | None = None
    learning_decay: float | None = None
    learning_offset: float | None = None
    max_iteration: int | None = None
    optimizer: str | None = None
    subsampling_rate: float | None = None
    seed: int | None = None


@dataclass(frozen=True)
class BisectingKMeans(Clusterer):
    k: int | None = None
    max_iteration: int | None = None
    seed: int | None = None
    min_divisible_cluster_size: float | None = None


@dataclass(frozen=True)
class GaussianMixture(Clusterer):
    k: int | None = None
    max_iteration: int | None = None
    tolerance: float | None = None
    seed: int | None = None


ESTIMATORS: dict[type[Spec], type[Estimator]] = {
    LogisticRegression: C.LogisticRegression,
    MultiLayerPerceptron: C.MultilayerPerceptronClassifier,
    DecisionTree: C.DecisionTreeClassifier,
    RandomForest: C.RandomForestClassifier,
    GradientBoostTree: C.GBTClassifier,
    NaiveBayes: C.NaiveBayes,
    LinearSupportVectorMachine: C.LinearSVC,
    LinearRegression: R.LinearRegression,
    GeneralizedLinearRegression: R.GeneralizedLinearRegression,
    RegressionTree: R.DecisionTreeRegressor,
    RandomRegressionForest: R.RandomForestRegressor,
    GradientBoostRegressionTree: R.GBTRegressor,
    KMeans: K.KMeans,
    LDA: K.LDA,
    BisectingKMeans: K.BisectingKMeans,
    GaussianMixture: K.GaussianMixture,
}


def build_estimator(spec: Spec, inputs: int | None = None, outputs: int | None = None) -> tuple[Estimator, dict]:
    """The estimator with the spec's values set, and {param: values} for its grids."""
    if type(spec) not in ESTIMATORS:
        raise TidemillError(f"no estimator for {type(spec).__name__}")
    estimator, grids = ESTIMATORS[type(spec)](), {}
    values = spec.params()
    if isinstance(spec, MultiLayerPerceptron):
        values.pop("hiddenLayers", None)
        if not inputs or not outputs:
            raise TidemillError("a perceptron needs the numbers of its inputs and classes")
        values["layers"] = [inputs, *spec.hidden_layers, outputs]
    for name, v in values.items():
        p = estimator.getParam(name)
        if isinstance(v, Grid):
            if isinstance(spec, Clusterer):
                raise TidemillError("clusterers have no grid search")
            grids[p] = list(v.values)
        else:
            estimator._set(**{name: v})
    return estimator, grids


def param_maps(grids: dict) -> list[dict]:
    """The cross product of grids."""
    return [dict(zip(grids, combo, strict=True)) for combo in product(*grids.values())]


def cluster_column(spec: Clusterer, predictions: DataFrame) -> DataFrame:
    """``cluster``, 0-based, beside all other columns."""
    if isinstance(spec, LDA):
        return predictions.withColumn("cluster", argmax(vector_to_array("topicDistribution")))
    if isinstance(spec, GaussianMixture):
        return predictions.withColumn("cluster", argmax(vector_to_array("probability")))
    return predictions.withColumn("cluster", F.col("prediction").cast("int"))
