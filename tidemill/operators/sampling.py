"""Splits and samples."""

from __future__ import annotations

import json

from pyspark.ml.param import TypeConverters
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.errors import TidemillError
from tidemill.operators.stages import Stage, need, param

DEFAULT_RATIO = 0.8


def random_split(df: DataFrame, ratio: float = DEFAULT_RATIO, seed: int | None = None) -> tuple[DataFrame, DataFrame]:
    a, b = df.randomSplit([ratio, 1 - ratio], seed)
    return a, b


def split_by_value(df: DataFrame, order: str, value: float) -> tuple[DataFrame, DataFrame]:
    return df.where(F.col(order) <= value), df.where(F.col(order) > value)


def seq_split(df: DataFrame, order: str, ratio: float = DEFAULT_RATIO, err: float = 0.001) -> tuple[DataFrame, DataFrame]:
    """The first ``ratio`` of the orders and the rest; ``err`` 0 gives the exact quantile."""
    if order not in df.columns:
        raise TidemillError(f"column {order} does not exist")
    found = df.approxQuantile(order, [ratio], err)
    return split_by_value(df, order, found[0]) if found else (df, df)


def choose_split(order: str, ratio: float | None = None, value: float | None = None, err: float = 0.001):
    """The split by value if one is given, else by ratio; a series has no default."""
    if value is not None:
        return lambda df: split_by_value(df, order, value)
    if ratio is not None:
        return lambda df: seq_split(df, order, ratio, err)
    raise TidemillError("a split of a series needs a ratio or an order value")


def forward_chain_splits(df: DataFrame, order: str, folds: int, min_ratio: float | None = None, err: float = 0.001) -> list[tuple[DataFrame, DataFrame, DataFrame]]:
    """(training, validation, both) for growing shares of a series: boundaries at min_ratio + i (1 - min_ratio) / folds."""
    least = 1 / (folds + 1) if min_ratio is None else min_ratio
    step = (1 - least) / folds
    bounds = df.approxQuantile(order, [least + i * step for i in range(folds)], err)
    top = df.agg(F.max(order)).first()[0]
    if not bounds or top is None:
        raise TidemillError("a series without rows cannot be split")
    o = F.col(order)
    return [(df.where(o <= a), df.where((o > a) & (o <= b)), df.where(o <= b)) for a, b in zip(bounds, [*bounds[1:], top], strict=True)]


class Sampling(Stage):
    """Rows of the listed labels sampled without replacement, all others kept; rows without a label drop.

    Needs ``labelString``; its metadata may give aliases, under which the labels are then listed. With
    ``training`` false everything passes, so predictions need not be thinned as the training rows are.
    """

    ratios = param("ratios", "label to share, as JSON", TypeConverters.toString)
    seed = param("seed", "seed", TypeConverters.toInt)
    training = param("training", "whether to sample", TypeConverters.toBoolean)
    defaults = {"seed": 42, "training": True}

    @staticmethod
    def of(ratios: list[tuple[str, float]], seed: int | None = None) -> Sampling:
        return Sampling(ratios=json.dumps(dict(ratios)), seed=seed)

    def _transform(self, df: DataFrame) -> DataFrame:
        need(df.schema, "labelString")
        if not self.value("training"):
            return df
        aliases = df.schema["labelString"].metadata.get("ml_attr", {}).get("aliases", {})
        alias = dict(zip(aliases.get("from", []), aliases.get("to", []), strict=False))
        ratios = {alias.get(k, k): float(v) for k, v in json.loads(self.required("ratios")).items()}
        keep = F.when(F.col("labelString").isNotNull(), 1.0)
        for label, ratio in ratios.items():
            keep = F.when(F.col("labelString") == label, ratio).otherwise(keep)
        return df.where(F.rand(self.value("seed")) < keep)
