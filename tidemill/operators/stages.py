"""Base of the pipeline stages and the general-purpose ones."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

from pyspark.ml import Estimator, Pipeline, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemill.errors import TidemillError


def param(name: str, doc: str, kind=TypeConverters.identity) -> Param:
    return Param(Params._dummy(), name, doc, kind)


class WithParams:
    """Keyword construction and plain reading of params; ``None`` leaves a param unset."""

    defaults: dict = {}

    def __init__(self, **values):
        super().__init__()
        self._setDefault(**self.defaults)
        self._set(**{k: v for k, v in values.items() if v is not None})

    def value(self, name: str, default=None):
        p = self.getParam(name)
        return self.getOrDefault(p) if self.isDefined(p) else default

    def required(self, name: str):
        p = self.getParam(name)
        if not self.isDefined(p):
            raise TidemillError(f"{type(self).__name__}: {name} is not set")
        return self.getOrDefault(p)


class Stage(WithParams, Transformer, DefaultParamsReadable, DefaultParamsWritable):
    pass


def need(schema: StructType, *names: str) -> None:
    for n in names:
        if n not in schema.names:
            raise TidemillError(f"column {n} does not exist")


def need_not(schema: StructType, name: str) -> None:
    if name in schema.names:
        raise TidemillError(f"column {name} exists already")


class RenameInPlace(Stage):
    """Put ``source`` in the place of ``target``: the old target goes, the renamed column stands last."""

    source = param("source", "column to rename", TypeConverters.toString)
    target = param("target", "its new name", TypeConverters.toString)

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.drop(self.required("target")).withColumnRenamed(self.required("source"), self.required("target"))


def in_place(make: Callable[[str, str], Transformer | Estimator], column: str) -> Pipeline:
    """A stage from ``column`` to a temporary one, which then takes its place."""
    temp = f"{column}_tmp"
    return Pipeline(stages=[make(column, temp), RenameInPlace(source=temp, target=column)])


class Apply(Transformer):
    """Any function from DataFrame to DataFrame that keeps the schema. Not written with a pipeline: code is not data."""

    def __init__(self, fn: Callable[[DataFrame], DataFrame]):
        super().__init__()
        self.fn = fn

    def copy(self, extra=None):
        return self

    def _transform(self, df: DataFrame) -> DataFrame:
        out = self.fn(df)
        if out.schema != df.schema:
            raise TidemillError("the function changed the schema")
        return out


class Cacher(Stage):
    """Cache what passes."""

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.cache()


class Keep(Stage):
    """Cache what passes, the last ``MOST`` frames of this stage and its copies at a time, until ``drop``; older ones are computed again if asked for."""

    MOST = 4

    def __init__(self):
        super().__init__()
        self.kept: deque[DataFrame] = deque()

    def copy(self, extra=None):
        return self

    def _transform(self, df: DataFrame) -> DataFrame:
        df = df.cache()
        self.kept.append(df)
        while len(self.kept) > self.MOST:
            self.kept.popleft().unpersist()
        return df

    def drop(self) -> None:
        while self.kept:
            self.kept.popleft().unpersist()


class FilterGroupsWithCount(Stage):
    """Keep the rows of groups of exactly ``expectedCount`` rows."""

    groupCol = param("groupCol", "column that names the group", TypeConverters.toString)
    expectedCount = param("expectedCount", "rows of a group that is kept", TypeConverters.toInt)

    def _transform(self, df: DataFrame) -> DataFrame:
        g, n = self.required("groupCol"), self.required("expectedCount")
        need(df.schema, g)
        # Counts are combined before the shuffle, so a large group that is dropped never moves.
        sizes = df.groupBy(F.col(g).alias("_g")).agg(F.count("*").alias("_n")).where(F.col("_n") == n)
        return df.join(sizes, F.col(g).eqNullSafe(F.col("_g")), "left_semi")


class DropSeriesLeft(Stage):
    """Keep rows whose order exceeds the smallest by more than ``count`` (so count 0 drops the first). Empty stays empty."""

    orderCol = param("orderCol", "order column", TypeConverters.toString)
    count = param("count", "how far from the smallest order rows are dropped", TypeConverters.toInt)

    def _transform(self, df: DataFrame) -> DataFrame:
        o, n = self.required("orderCol"), self.required("count")
        need(df.schema, o)
        least = df.agg(F.min(o).alias("_least"))  # one row
        return df.join(F.broadcast(least), F.col(o) > F.col("_least") + n).drop("_least")
