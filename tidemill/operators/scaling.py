"""Column scalers. The norms here are those of columns, not of rows."""

from __future__ import annotations

from pyspark.ml import Estimator, Pipeline, Transformer
from pyspark.ml.feature import PCA, MaxAbsScaler, MinMaxScaler, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.errors import TidemillError
from tidemill.functions import vectors
from tidemill.operators.prep import VectorHead
from tidemill.operators.stages import RenameInPlace, Stage, WithParams, in_place, need_not, param

# The kinds of scalers.
KINDS = ("L1Normalizer", "L2Normalizer", "StandardScaler", "MinMaxPlusMinusOneScaler", "MinMaxZeroOneScaler", "MaxAbsScaler")


class ColumnNormModel(Stage):
    """Divide each element by its column's norm; a zero norm leaves it as it is."""

    inputCol = param("inputCol", "vector column", TypeConverters.toString)
    outputCol = param("outputCol", "scaled column", TypeConverters.toString)
    norms = param("norms", "one norm for each element", TypeConverters.toListFloat)

    def _transform(self, df: DataFrame) -> DataFrame:
        need_not(df.schema, self.required("outputCol"))
        norms = F.array(*[F.lit(n if n else 1.0) for n in self.required("norms")])
        scaled = F.zip_with(vector_to_array(self.required("inputCol")), norms, lambda x, n: x / n)
        return df.withColumn(self.required("outputCol"), array_to_vector(scaled))


class ColumnScaleModel(Stage):
    """(x - shift) / by * width + low for each element, in this order of operations; where ``by`` is 0 the result is ``flat``."""

    inputCol = param("inputCol", "vector column", TypeConverters.toString)
    outputCol = param("outputCol", "scaled column", TypeConverters.toString)
    shift = param("shift", "one number for each element", TypeConverters.toListFloat)
    by = param("by", "one number for each element", TypeConverters.toListFloat)
    width = param("width", "factor of the result", TypeConverters.toFloat)
    low = param("low", "added to the result", TypeConverters.toFloat)
    flat = param("flat", "result of a constant column", TypeConverters.toFloat)
    defaults = {"width": 1.0, "low": 0.0}

    def _transform(self, df: DataFrame) -> DataFrame:
        need_not(df.schema, self.required("outputCol"))
        stats = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in zip(self.required("shift"), self.required("by"), strict=True)])
        width, low, flat = self.required("width"), self.required("low"), self.required("flat")

        def one(x, s):
            y = (x - s["a"]) / F.when(s["b"] != 0, s["b"])
            y = y if width == 1 else y * F.lit(width)
            return F.when(s["b"] == 0, F.when(F.isnan(x), x).otherwise(flat)).otherwise(y if low == 0 else y + F.lit(low))

        scaled = F.zip_with(vector_to_array(self.required("inputCol")), stats, one)
        return df.withColumn(self.required("outputCol"), array_to_vector(scaled))


class ColumnScaler(WithParams, Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Standard or min-max scaling, dividing by the deviation or the range itself: multiplying by its reciprocal gives other last bits."""

    inputCol = param("inputCol", "vector column", TypeConverters.toString)
    outputCol = param("outputCol", "scaled column", TypeConverters.toString)
    kind = param("kind", "StandardScaler, MinMaxZeroOneScaler or MinMaxPlusMinusOneScaler", TypeConverters.toString)

    def _fit(self, df: DataFrame) -> ColumnScaleModel:
        io = {"inputCol": self.required("inputCol"), "outputCol": self.required("outputCol")}
        kind = self.required("kind")
        if kind == "StandardScaler":
            model = StandardScaler(withMean=True, withStd=True, **io).fit(df)
            return ColumnScaleModel(shift=model.mean.toArray().tolist(), by=model.std.toArray().tolist(), flat=0.0, **io)
        model = MinMaxScaler(**io).fit(df)
        least, most = model.originalMin.toArray(), model.originalMax.toArray()
        width, low = (2.0, -1.0) if kind == "MinMaxPlusMinusOneScaler" else (1.0, 0.0)
        return ColumnScaleModel(shift=least.tolist(), by=(most - least).tolist(), width=width, low=low, flat=width / 2 + low, **io)


class ColumnNormNormalizer(WithParams, Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Learn the p-norm of every column, p >= 1 or infinity."""

    inputCol = param("inputCol", "vector column", TypeConverters.toString)
    outputCol = param("outputCol", "scaled column", TypeConverters.toString)
    p = param("p", "order of the norm", TypeConverters.toFloat)
    defaults = {"p": 2.0}

    def _fit(self, df: DataFrame) -> ColumnNormModel:
        source = self.required("inputCol")
        row = vectors.column_norms(df.select(source), source, self.value("p")).first()
        return ColumnNormModel(inputCol=source, outputCol=self.required("outputCol"), norms=row[0] if row and row[0] else [])


def vector_scaler(kind: str, source: str = "features", target: str = "scaledFeatures") -> Estimator:
    io = {"inputCol": source, "outputCol": target}
    match kind:
        case "L1Normalizer":
            return ColumnNormNormalizer(p=1.0, **io)
        case "L2Normalizer":
            return ColumnNormNormalizer(p=2.0, **io)
        case "StandardScaler" | "MinMaxPlusMinusOneScaler" | "MinMaxZeroOneScaler":
            return ColumnScaler(kind=kind, **io)
        case "MaxAbsScaler":
            return MaxAbsScaler(**io)
    raise TidemillError(f"no scaler of kind {kind}")


def vector_scaler_in_place(kind: str, column: str = "features") -> Pipeline:
    return in_place(lambda a, b: vector_scaler(kind, a, b), column)


class DropColumns(Stage):
    columns = param("columns", "columns to drop", TypeConverters.toListString)

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.drop(*self.required("columns"))


def numeric_scaler(kind: str, source: str, target: str) -> Pipeline:
    """A number scaled as a vector of one."""
    one, scaled = f"{target}_vector", f"{target}_scaled"
    return Pipeline(stages=[VectorAssembler(inputCols=[source], outputCol=one), vector_scaler(kind, one, scaled), VectorHead(inputCol=scaled, outputCol=target), DropColumns(columns=[one, scaled])])


def numeric_scaler_in_place(kind: str, column: str) -> Pipeline:
    temp = f"{column}_tmp"
    return Pipeline(stages=[numeric_scaler(kind, column, temp), RenameInPlace(source=temp, target=column)])


def in_place_pca(k: int, column: str = "features") -> Pipeline:
    return in_place(lambda a, b: PCA(k=k, inputCol=a, outputCol=b), column)


def transformed(stage: Transformer | Estimator, df: DataFrame) -> DataFrame:
    """Fit if need be, and transform."""
    return (stage.fit(df) if isinstance(stage, Estimator) else stage).transform(df)
