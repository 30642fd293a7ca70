"""Turning raw tables into feature and label frames."""

from __future__ import annotations

from pyspark.ml.feature import OneHotEncoder, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.param import TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.ml import Estimator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.errors import TidemillError
from tidemill.functions import vectors
from tidemill.operators.stages import Stage, WithParams, need, need_not, param


def attributes(df: DataFrame, column: str) -> dict:
    return df.schema[column].metadata.get("ml_attr", {})


def input_size(df: DataFrame, features: str = "features") -> int | None:
    return attributes(df, features).get("num_attrs")


def output_size(df: DataFrame, label: str = "label") -> int | None:
    values = attributes(df, label).get("vals")
    return len(values) if values else None


def prepare_features(df: DataFrame, features: set[str], output: str | None = None, drop_features: bool = True, drop_nulls: bool = True) -> DataFrame:
    """``features`` (in the frame's column order; unknown names are passed over) and, if given, ``output`` as ``label``.

    An output that is a feature too is assembled and kept as the label.
    """
    if drop_nulls:
        df = df.na.drop()
    names = [c for c in df.columns if c in features]
    assembled = VectorAssembler(inputCols=names, outputCol="features").transform(df)
    if output is not None and output != "label":
        assembled = assembled.withColumnRenamed(output, "label")
    return assembled.drop(*[n for n in names if n != output]) if drop_features else assembled


def index_strings(df: DataFrame, columns: list[tuple[str, list[str] | None]]) -> DataFrame:
    """Each column replaced by its index (last in the schema): in the given order of labels, else by falling frequency, ties by name. Unknown values drop their row."""
    for name, labels in columns:
        temp = f"{name}_indexed"
        if labels:
            model = StringIndexerModel.from_labels(labels, inputCol=name, outputCol=temp, handleInvalid="skip")
        else:
            model = StringIndexer(inputCol=name, outputCol=temp, handleInvalid="skip").fit(df)
        df = model.transform(df).drop(name).withColumnRenamed(temp, name)
    return df


class FixedOrderStringIndexer(WithParams, Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Index by the place in ``labels``; fitting looks at no data."""

    inputCol = param("inputCol", "string column", TypeConverters.toString)
    outputCol = param("outputCol", "index column", TypeConverters.toString)
    labels = param("labels", "labels in order", TypeConverters.toListString)
    handleInvalid = param("handleInvalid", "error, skip or keep", TypeConverters.toString)
    defaults = {"handleInvalid": "error"}

    def _fit(self, df: DataFrame) -> StringIndexerModel:
        labels = self.required("labels")
        if not labels:
            raise TidemillError("labels must not be empty")
        return StringIndexerModel.from_labels(labels, inputCol=self.required("inputCol"), outputCol=self.required("outputCol"), handleInvalid=self.value("handleInvalid"))


class BooleanLabelIndexer(Stage):
    """A boolean ``label`` becomes 0.0 or 1.0 with its classes as metadata, and on request a string copy; any other label passes."""

    stringLabelCol = param("stringLabelCol", "name of the string copy", TypeConverters.toString)

    def _transform(self, df: DataFrame) -> DataFrame:
        need(df.schema, "label")
        if not isinstance(df.schema["label"].dataType, T.BooleanType):
            return df
        copy = self.value("stringLabelCol")
        name = copy or "_label_string"
        text = df.withColumn(name, F.col("label").cast("string").alias(name, metadata=df.schema["label"].metadata)).drop("label")
        out = StringIndexerModel.from_labels(["false", "true"], inputCol=name, outputCol="label", handleInvalid="keep").transform(text.where(F.col(name).isNotNull()))
        out = out.withColumn("label", F.col("label").alias("label", metadata={"ml_attr": {"type": "nominal", "name": "label", "vals": ["false", "true"]}}))
        return out if copy else out.drop(name)


class IndexToStringIfNeeded(Stage):
    """The label of an index, from its metadata; nothing to do where the output exists."""

    inputCol = param("inputCol", "index column", TypeConverters.toString)
    outputCol = param("outputCol", "string column", TypeConverters.toString)

    def _transform(self, df: DataFrame) -> DataFrame:
        source, target = self.required("inputCol"), self.required("outputCol")
        if target in df.columns:
            return df
        need(df.schema, source)
        values = attributes(df, source).get("vals")
        if not values:
            raise TidemillError(f"column {source} carries no labels")
        return df.withColumn(target, F.element_at(F.array(*[F.lit(v) for v in values]), F.col(source).cast("int") + 1))


class IndexVectorizer(Stage):
    """Sparse one-hot vectors, the last category kept; the width is one more than the largest index of the data, or ``size`` if larger."""

    inputCol = param("inputCol", "column of non-negative whole numbers", TypeConverters.toString)
    outputCol = param("outputCol", "vector column", TypeConverters.toString)
    size = param("size", "least width", TypeConverters.toInt)
    defaults = {"size": 0}

    def _transform(self, df: DataFrame) -> DataFrame:
        source, target = self.required("inputCol"), self.required("outputCol")
        need(df.schema, source)
        need_not(df.schema, target)
        index = F.col(source).cast("double")
        most = df.agg(F.max(index)).first()[0]
        width = max(-1 if most is None else int(most), self.value("size") - 1, 0) + 1
        place = F.when((index >= 0) & (index == F.floor(index)), index).otherwise(F.raise_error(F.concat(F.lit("not a category index: "), F.coalesce(index.cast("string"), F.lit("null")))).cast("double"))
        widest = df.sparkSession.createDataFrame([(float(width - 1),)], "_index double")
        encoder = OneHotEncoder(inputCol="_index", outputCol=target, dropLast=False).fit(widest)  # its width is all it learns
        return encoder.transform(df.withColumn("_index", place)).drop("_index")


class VectorHead(Stage):
    """The first element as a double; nothing to do where the output exists."""

    inputCol = param("inputCol", "vector column", TypeConverters.toString)
    outputCol = param("outputCol", "double column", TypeConverters.toString)

    def _transform(self, df: DataFrame) -> DataFrame:
        source, target = self.required("inputCol"), self.required("outputCol")
        if target in df.columns:
            return df
        if not vectors.is_vector(df, source):
            raise TidemillError(f"{source} is not a vector")
        return df.withColumn(target, vectors.head(source))


def join_by_order(left: DataFrame, right: DataFrame, left_order: str, right_order: str) -> DataFrame:
    """Rows paired by their place in each frame's own order; the longer frame's rest drops."""
    from tidemill.operators.windows import with_rank

    return with_rank(left, left_order, "_place").join(with_rank(right, right_order, "_place"), "_place").drop("_place")
