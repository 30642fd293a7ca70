"""Training, validation and evaluation: prepare stages, split, fit (with a grid search if asked), predict, evaluate, repeat."""

from __future__ import annotations

import logging
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Pipeline
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.errors import TidemillError
from tidemill.operators import metrics as M
from tidemill.operators.learners import Classifier, Clusterer, GaussianMixture, Grid, MultiLayerPerceptron, Regressor, build_estimator, cluster_column, param_maps
from tidemill.operators.mixture import fit_mixture
from tidemill.operators.prep import IndexToStringIfNeeded, input_size, output_size
from tidemill.operators.reservoir import ReservoirSpec, ReservoirStates
from tidemill.operators.results import ClassificationSetting, RegressionSetting, Results, ServiceSetting, TemporalSetting
from tidemill.operators.sampling import Sampling, choose_split, random_split
from tidemill.operators.scaling import in_place_pca, numeric_scaler_in_place, vector_scaler_in_place
from tidemill.operators.stages import Keep, RenameInPlace
from tidemill.operators.validation import forward_cv, kfold_cv
from tidemill.operators.windows import SeqShift, SlidingWindow, independent_predictions, order_dependent_predictions

log = logging.getLogger(__name__)


# --- stages -------------------------------------------------------------------------------------------------------


def classification_stages(setting: ClassificationSetting) -> list:
    stages = _feature_stages(setting)
    if setting.sampling_ratios:
        stages += [IndexToStringIfNeeded(inputCol="label", outputCol="labelString"), Sampling.of(setting.sampling_ratios)]
    return stages


def regression_stages(setting: RegressionSetting) -> list:
    """With output normalization the label, and so every metric, is in normalized units."""
    return _feature_stages(setting) + ([numeric_scaler_in_place(setting.output_normalization, "label")] if setting.output_normalization else [])


def _feature_stages(setting) -> list:
    stages = []
    if setting.features_normalization:
        stages.append(vector_scaler_in_place(setting.features_normalization))
    if setting.pca_dims:
        stages.append(in_place_pca(setting.pca_dims))
    return stages


def temporal_stages(setting: TemporalSetting, service: ServiceSetting) -> tuple[list, dict]:
    """Window, then reservoir with washout, then the label's shift; and the grids of their params."""
    stages, grids = [], {}

    def put(stage, name, value):
        if isinstance(value, Grid):
            grids[stage.getParam(name)] = list(value.values)
        elif value is not None:
            stage._set(**{name: value})

    order, group = setting.order_col, setting.group_col
    if setting.sliding_window is not None:
        window = SlidingWindow(inputCol="features", outputCol="features_window", orderCol=order, groupCol=group, consecutive=service.consecutive_order)
        put(window, "windowSize", setting.sliding_window)
        stages += [window, RenameInPlace(source="features_window", target="features")]
    if setting.reservoir is not None:
        if group:
            raise TidemillError("a reservoir runs over one series, not over groups")
        spec = setting.reservoir
        own = {"nodes": spec.nodes, "spectralRadius": spec.spectral_radius, "inDegree": spec.in_degree, "edges": spec.edges, "inputConnectivity": spec.input_connectivity}
        fixed = ReservoirSpec(**{**spec.__dict__, "washout": None, **{k: v for k, v in (("nodes", 10), ("spectral_radius", None), ("in_degree", None), ("edges", None), ("input_connectivity", None)) if isinstance(getattr(spec, k), Grid)}})
        states = ReservoirStates(inputCol="features", outputCol="features_states", orderCol=order, spec=ReservoirStates.spec_json(fixed), seed=service.seed)
        for name, value in own.items():
            if isinstance(value, Grid):
                put(states, name, value)
        put(states, "washout", spec.washout)
        stages += [states, RenameInPlace(source="features_states", target="features")]
    if not stages:
        log.warning("neither a sliding window nor a reservoir is set")
    else:
        stages.append(Keep())  # the shift, the fit and the judging all ask for it
    shift = SeqShift(inputCol="label", outputCol="label_shifted", orderCol=order, groupCol=group, shift=setting.predict_ahead, consecutive=service.consecutive_order)
    return [*stages, shift, RenameInPlace(source="label_shifted", target="label")], grids


def kernel_size(setting: TemporalSetting | None, inputs: int | None, chosen: dict | None = None) -> int | None:
    """Features after the temporal kernels; ``chosen`` gives the value of a grid."""
    if setting is None or inputs is None:
        return inputs
    pick = lambda name, v: (chosen or {}).get(name) if isinstance(v, Grid) else v
    if setting.reservoir is not None:
        return pick("nodes", setting.reservoir.nodes)
    if setting.sliding_window is not None:
        n = pick("windowSize", setting.sliding_window)
        return None if n is None else n * inputs
    return inputs


# --- evaluation ---------------------------------------------------------------------------------------------------


def evaluate_safely(evaluators: dict, frames: dict[str, DataFrame]) -> dict[str, dict[str, float]]:
    """{metric: {split: value}}; an empty frame has no value. A metric that fails ends the run: a result without it would look whole."""
    filled = {s: df for s, df in frames.items() if not df.isEmpty()}
    out: dict[str, dict[str, float]] = {}
    for name, evaluator in evaluators.items():
        out[name] = {}
        for split, df in filled.items():
            try:
                out[name][split] = evaluator.evaluate(df)
            except Exception as e:
                raise TidemillError(f"{name} of the {split} rows could not be evaluated: {e}") from e
    return out


def without_sampling(model):
    """The fitted model, its sampling stages letting everything pass: what is judged is not thinned as training rows are."""
    for stage in getattr(getattr(model, "bestModel", model), "stages", []):
        if isinstance(stage, Sampling):
            stage._set(training=False)
    return model


def collect_outputs(df: DataFrame, whole: bool, order: str = "index") -> list[tuple]:
    """(label, prediction) pairs, in order if there is an order column."""
    kind = int if whole else float
    rows = (df.orderBy(order) if order in df.columns else df).select("label", "prediction").collect()
    return [(kind(r[0]), kind(r[1])) for r in rows]


class Points(Sequence):
    """A curve's points, as many as the data have scores: collected when first looked at."""

    def __init__(self, collect: Callable[[], list]):
        self._collect, self._points = collect, None

    def _all(self) -> list:
        if self._points is None:
            self._points = self._collect()
        return self._points

    def __getitem__(self, k):
        return self._all()[k]

    def __len__(self) -> int:
        return len(self._all())

    def __eq__(self, other) -> bool:
        return self._all() == list(other)

    def __repr__(self) -> str:
        return repr(self._all())


def binary_curves(df: DataFrame, score: str, bins: int) -> dict[str, Sequence]:
    pairs = lambda frame, *order: [(r["x"], r["y"]) for r in frame.orderBy(*order).collect()]
    by_threshold = lambda y: Points(lambda: [(r["threshold"], r[y]) for r in M.threshold_curves(df, score, bins).select("threshold", y).orderBy(F.desc("threshold")).collect()])
    return {
        "roc": Points(lambda: pairs(M.roc_curve(df, score, bins), "x", "y")),
        "precisionRecall": Points(lambda: pairs(M.pr_curve(df, score, bins), "x")),
        "f1Threshold": by_threshold("f1"),
        "precisionThreshold": by_threshold("precision"),
        "recallThreshold": by_threshold("recall"),
    }


# --- the service --------------------------------------------------------------------------------------------------


class LearningService:
    def __init__(self, setting: ServiceSetting | None = None):
        self.setting = setting or ServiceSetting()

    def classify(self, df: DataFrame, spec: Classifier, setting: ClassificationSetting | None = None, replication: DataFrame | None = None) -> Results:
        return self._learn(df, spec, setting or ClassificationSetting(), None, replication)

    def classify_time_series(self, df: DataFrame, spec: Classifier, setting: TemporalSetting, replication: DataFrame | None = None) -> Results:
        return self._learn(df, spec, setting.core, setting, replication)

    def regress(self, df: DataFrame, spec: Regressor, setting: RegressionSetting | None = None, replication: DataFrame | None = None) -> Results:
        return self._learn(df, spec, setting or RegressionSetting(), None, replication)

    def regress_time_series(self, df: DataFrame, spec: Regressor, setting: TemporalSetting, replication: DataFrame | None = None) -> Results:
        return self._learn(df, spec, setting.core, setting, replication)

    def cluster(self, df: DataFrame, spec: Clusterer, normalization: str | None = None, pca_dims: int | None = None) -> DataFrame:
        """All columns of ``df`` and ``cluster``."""
        stages = ([vector_scaler_in_place(normalization)] if normalization else []) + ([in_place_pca(pca_dims)] if pca_dims else [])
        ready = Pipeline(stages=stages).fit(df).transform(df) if stages else df
        estimator = build_estimator(spec)[0]
        model = fit_mixture(estimator, ready) if isinstance(spec, GaussianMixture) else estimator.fit(ready)
        return cluster_column(spec, model.transform(ready))

    def _learn(self, df: DataFrame, spec, setting, temporal: TemporalSetting | None, replication: DataFrame | None) -> Results:
        classes = output_size(df) if isinstance(spec, Classifier) else None
        inputs = input_size(df)
        if isinstance(spec, Classifier):
            binary = classes == 2
            stages, evaluators = classification_stages(setting), M.classification_evaluators(binary, self.setting.binary_score)
            default = "accuracy"
            complete = (lambda d: M.one_hot_prediction(d, self.setting.binary_score)) if binary else (lambda d: d)
        else:
            binary = False
            stages = regression_stages(setting) if isinstance(setting, RegressionSetting) else _feature_stages(setting)
            evaluators, default, complete = M.regression_evaluators(), "rmse", lambda d: d
        grids: dict = {}
        if temporal is not None:
            more, grids = temporal_stages(temporal, self.setting)
            stages += more
            split: Callable = choose_split(temporal.order_col, setting.split_ratio, temporal.split_order_value)
            predict = lambda m, full, test: order_dependent_predictions(m, full, test, temporal.order_col)
        else:
            split, predict = None, independent_predictions
        size = kernel_size(temporal, setting.pca_dims or inputs)
        if size is None and isinstance(spec, MultiLayerPerceptron):
            raise TidemillError("a perceptron's input layer cannot follow a grid of window or reservoir sizes")
        estimator, own = build_estimator(spec, size, classes)
        maps = param_maps(grids | own)
        if len(maps) > 1 and not setting.folds:
            raise TidemillError("a grid needs cross-validation folds")
        trainer = Pipeline(stages=[*stages, estimator])
        if setting.folds and maps:
            evaluator = evaluators.get(setting.cv_metric, evaluators[default])
            make = forward_cv(temporal.order_col, setting.folds, temporal.min_cv_training_ratio, complete) if temporal is not None else kfold_cv(setting.folds, self.setting.seed)
            trainer = make(trainer, maps, evaluator)
        df = df.cache()
        repetitions = setting.repetitions or 1

        def once(k: int):
            train, test = split(df) if split else random_split(df, setting.split_ratio or 0.8, self.setting.seed + k)
            model = without_sampling(trainer.fit(train))
            frames = {"training": model.transform(train), "test": predict(model, df, test)}
            if replication is not None:
                frames["replication"] = model.transform(replication)
            frames = {s: complete(f).cache() for s, f in frames.items()}
            try:
                if self.setting.debug:
                    for f in frames.values():
                        f.show(truncate=False)
                values = evaluate_safely(evaluators, frames)
                curves = {}
                if binary:
                    curves = {s: binary_curves(f, self.setting.binary_score, setting.bin_curves_bins or 0) for s, f in frames.items() if isinstance(setting, ClassificationSetting) and not f.isEmpty()}
                order = temporal.order_col if temporal is not None else "index"
                outputs = {s: collect_outputs(f, isinstance(spec, Classifier), order) for s, f in frames.items()} if setting.collect_outputs else {}
                return values, (train.count(), test.count()), curves, outputs
            finally:
                for f in frames.values():
                    f.unpersist()

        try:
            with ThreadPoolExecutor(self.setting.repetition_parallelism) as pool:
                done = list(pool.map(once, range(repetitions)))
        finally:
            df.unpersist()
            for stage in stages:
                if isinstance(stage, Keep):
                    stage.drop()
        results = Results(counts=[d[1] for d in done], curves=[d[2] for d in done], outputs=[d[3] for d in done])
        for values, *_ in done:
            for metric, by_split in values.items():
                results.metrics.setdefault(metric, []).append(by_split)
        return results


__all__ = ["LearningService", "binary_curves", "classification_stages", "collect_outputs", "evaluate_safely", "kernel_size", "regression_stages", "temporal_stages"]
