"""k-fold and forward-chaining cross-validation."""

from __future__ import annotations

from collections.abc import Callable
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark.ml import Estimator, Model, Pipeline
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.tuning import CrossValidator
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame

from tidemill.errors import TidemillError
from tidemill.operators.sampling import forward_chain_splits
from tidemill.operators.windows import order_dependent_predictions


def kfold_cv(folds: int, seed: int = 42, parallelism: int = 2) -> Callable:
    """(estimator, param maps, evaluator) to a k-fold CrossValidator."""
    return lambda estimator, maps, evaluator: CrossValidator(estimator=estimator, estimatorParamMaps=maps or [{}], evaluator=evaluator, numFolds=folds, seed=seed, parallelism=parallelism)


class ForwardChainingCrossValidator(Estimator, MLWritable, MLReadable):
    """Choose a param map on growing shares of a series and refit it on all rows.

    Each fold trains on the orders up to a boundary and validates on those up to the next; predictions see the whole
    series so far, so windows reach back into training rows. ``process`` may complete predictions before evaluation; a
    validator with one cannot be written. A map whose average is no finite number is never chosen.
    """

    def __init__(self, estimator: Estimator, maps: list[dict], evaluator: Evaluator, order_col: str, folds: int = 3, min_ratio: float | None = None, process: Callable[[DataFrame], DataFrame] | None = None, parallelism: int = 2, err: float = 0.001):
        super().__init__()
        self.estimator, self.maps, self.evaluator = estimator, maps or [{}], evaluator
        self.order_col, self.folds, self.min_ratio = order_col, folds, min_ratio
        self.process, self.parallelism, self.err = process, parallelism, err

    def copy(self, extra=None):
        return ForwardChainingCrossValidator(self.estimator.copy(extra), self.maps, self.evaluator, self.order_col, self.folds, self.min_ratio, self.process, self.parallelism, self.err)

    def write(self) -> MLWriter:
        return _ValidatorWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ValidatorReader()

    def _fit(self, df: DataFrame) -> ForwardChainingCrossValidatorModel:
        totals = np.zeros(len(self.maps))
        for train, validation, both in forward_chain_splits(df, self.order_col, self.folds, self.min_ratio, self.err):
            train, validation = train.cache(), validation.cache()
            try:
                if validation.isEmpty():
                    raise TidemillError("a validation fold has no rows")

                def score(item: dict, train=train, validation=validation, both=both) -> float:
                    model = self.estimator.fit(train, item)
                    predicted = order_dependent_predictions(model, both, validation, self.order_col)
                    return self.evaluator.evaluate(self.process(predicted) if self.process else predicted)

                with ThreadPool(min(self.parallelism, len(self.maps))) as pool:
                    totals += np.array(pool.map(score, self.maps))
            finally:
                train.unpersist()
                validation.unpersist()
        metrics = (totals / self.folds).tolist()
        best = best_of(metrics, self.evaluator.isLargerBetter())
        return ForwardChainingCrossValidatorModel(self.estimator.fit(df, self.maps[best]), metrics, best)


def best_of(metrics: list[float], larger_better: bool) -> int:
    """The place of the best finite metric, the first of equals."""
    finite = [k for k, m in enumerate(metrics) if np.isfinite(m)]
    if not finite:
        raise TidemillError(f"no param map has a finite metric: {metrics}")
    return (max if larger_better else min)(finite, key=lambda k: metrics[k])


class _ValidatorWriter(MLWriter):
    """Settings beside ``estimator`` and ``evaluator``; a param of a map is named by its stage and name."""

    def __init__(self, validator: ForwardChainingCrossValidator):
        super().__init__()
        self.validator = validator

    def saveImpl(self, path: str) -> None:
        v = self.validator
        if v.process is not None:
            raise TidemillError("a validator that completes predictions cannot be written")
        maps = [[{"parent": p.parent, "name": p.name, "value": x} for p, x in m.items()] for m in v.maps]
        extra = {"maps": maps, "order_col": v.order_col, "folds": v.folds, "min_ratio": v.min_ratio, "parallelism": v.parallelism, "err": v.err}
        DefaultParamsWriter.saveMetadata(v, path, self.sparkSession, extraMetadata=extra)
        v.estimator.save(f"{path}/estimator")
        v.evaluator.save(f"{path}/evaluator")


class _ValidatorReader(MLReader):
    def load(self, path: str) -> ForwardChainingCrossValidator:
        own = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        estimator = DefaultParamsReader.loadParamsInstance(f"{path}/estimator", self.sparkSession)
        evaluator = DefaultParamsReader.loadParamsInstance(f"{path}/evaluator", self.sparkSession)
        stages = {s.uid: s for s in _with_parts(estimator)}
        maps = [{stages[x["parent"]].getParam(x["name"]): x["value"] for x in m} for m in own["maps"]]
        v = ForwardChainingCrossValidator(estimator, maps, evaluator, own["order_col"], own["folds"], own["min_ratio"], None, own["parallelism"], own["err"])
        return v._resetUid(own["uid"])


def _with_parts(stage) -> list:
    return [stage, *(p for s in (stage.getStages() if isinstance(stage, Pipeline) else []) for p in _with_parts(s))]


class ForwardChainingCrossValidatorModel(Model):
    def __init__(self, best_model: Model, avg_metrics: list[float], best_index: int):
        super().__init__()
        self.bestModel, self.avgMetrics, self.bestIndex = best_model, avg_metrics, best_index

    def _transform(self, df: DataFrame) -> DataFrame:
        return self.bestModel.transform(df)

    def save(self, path: str) -> None:
        """The best model under ``best``, the averages beside it."""
        self.bestModel.write().overwrite().save(f"{path}/best")
        from pyspark.sql import SparkSession

        SparkSession.active().createDataFrame([(k, m, k == self.bestIndex) for k, m in enumerate(self.avgMetrics)], "map int, metric double, best boolean").coalesce(1).write.mode("overwrite").json(f"{path}/metrics")

    @staticmethod
    def load(path: str) -> ForwardChainingCrossValidatorModel:
        from pyspark.ml import PipelineModel
        from pyspark.sql import SparkSession

        rows = sorted(SparkSession.active().read.json(f"{path}/metrics").collect(), key=lambda r: r["map"])
        return ForwardChainingCrossValidatorModel(PipelineModel.load(f"{path}/best"), [r["metric"] for r in rows], next(r["map"] for r in rows if r["best"]))


def forward_cv(order_col: str, folds: int, min_ratio: float | None = None, process=None, parallelism: int = 2, err: float = 0.001) -> Callable:
    """(estimator, param maps, evaluator) to a forward-chaining validator."""
    return lambda estimator, maps, evaluator: ForwardChainingCrossValidator(estimator, maps, evaluator, order_col, folds, min_ratio, process, parallelism, err)
