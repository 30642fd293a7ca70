"""Settings, run specs and results."""

from __future__ import annotations

import statistics
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from tidemill.errors import TidemillError
from tidemill.operators.reservoir import ReservoirSpec

SPLITS = ("training", "test", "replication")


@dataclass(frozen=True)
class ServiceSetting:
    repetition_parallelism: int = 2
    binary_score: str = "probability"
    consecutive_order: bool = False
    debug: bool = False
    seed: int = 42


@dataclass(frozen=True)
class LearningSetting:
    """``features_selection_num`` is recorded only."""

    features_normalization: str | None = None
    features_selection_num: int | None = None
    pca_dims: int | None = None
    split_ratio: float | None = None
    sampling_ratios: list[tuple[str, float]] = field(default_factory=list)
    repetitions: int | None = None
    folds: int | None = None
    cv_metric: str | None = None
    collect_outputs: bool = False


@dataclass(frozen=True)
class ClassificationSetting(LearningSetting):
    bin_curves_bins: int | None = None


@dataclass(frozen=True)
class RegressionSetting(LearningSetting):
    output_normalization: str | None = None


@dataclass(frozen=True)
class TemporalSetting:
    core: LearningSetting = LearningSetting()
    predict_ahead: int = 1
    sliding_window: Any = None
    reservoir: ReservoirSpec | None = None
    min_cv_training_ratio: float | None = None
    split_order_value: float | None = None
    order_col: str = "index"
    group_col: str | None = None


@dataclass(frozen=True)
class IOSpec:
    input_fields: list[str]
    output_field: str
    order_field: str | None = None
    group_field: str | None = None
    filter_id: str | None = None
    replication_filter_id: str | None = None

    def all_fields(self) -> list[str]:
        extra = [x for x in (self.order_field, self.group_field) if x]
        return list(dict.fromkeys([*self.input_fields, self.output_field, *extra]))


@dataclass(frozen=True)
class RunSpec:
    io: IOSpec
    model_id: str
    setting: LearningSetting | TemporalSetting


@dataclass
class Performance:
    """Values of one metric: (training, test, replication) for each repetition, None where there is none."""

    metric: str
    values: list[tuple[float, float | None, float | None]]


@dataclass(frozen=True)
class MetricStats:
    mean: float
    min: float
    max: float
    variance: float
    median: float | None

    @staticmethod
    def of(values: list[float]) -> MetricStats:
        return MetricStats(statistics.fmean(values), min(values), max(values), statistics.variance(values) if len(values) > 1 else 0.0, statistics.median(values))


@dataclass
class Results:
    """``metrics``: by metric, one {split: value} for each repetition. ``counts``: (training, test) rows. ``curves`` and ``outputs``: by repetition and split."""

    metrics: dict[str, list[dict[str, float]]] = field(default_factory=dict)
    counts: list[tuple[int, int]] = field(default_factory=list)
    curves: list[dict[str, dict[str, list]]] = field(default_factory=list)
    outputs: list[dict[str, list[tuple]]] = field(default_factory=list)

    def performances(self) -> list[Performance]:
        return [Performance(m, [tuple(v.get(s) for s in SPLITS) for v in values]) for m, values in self.metrics.items()]

    def stats(self) -> dict[str, dict[str, MetricStats | None]]:
        out = {}
        for metric, values in self.metrics.items():
            out[metric] = {}
            for split in SPLITS:
                found = [v[split] for v in values if v.get(split) is not None]
                if split == "training" and not found:
                    raise TidemillError(f"{metric} has no training value")
                out[metric][split] = MetricStats.of(found) if found else None
        return out

    def frame(self, spark: SparkSession) -> DataFrame:
        """(metric, repetition, split, value)."""
        rows = [(m, k, s, float(x)) for m, values in sorted(self.metrics.items()) for k, v in enumerate(values) for s, x in v.items() if x is not None]
        return spark.createDataFrame(rows, "metric string, repetition int, split string, value double")


@dataclass
class RunResult:
    """A run's spec with its statistics; input fields are kept in order of name."""

    spec: RunSpec
    stats: dict[str, dict[str, MetricStats | None]]
    curves: list[dict[str, dict[str, list]]] = field(default_factory=list)

    @staticmethod
    def of(spec: RunSpec, results: Results) -> RunResult:
        io = spec.io
        ordered = IOSpec(sorted(io.input_fields), io.output_field, io.order_field, io.group_field, io.filter_id, io.replication_filter_id)
        return RunResult(RunSpec(ordered, spec.model_id, spec.setting), results.stats(), results.curves)
