"""Vector columns as Catalyst expressions. Sparse vectors count with their implicit zeros throughout."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def is_vector(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, VectorUDT)


def as_array(df: DataFrame, name: str) -> Column:
    """The column as array<double>, whether it is a vector, an array or a number."""
    if is_vector(df, name):
        return vector_to_array(F.col(name))
    if isinstance(df.schema[name].dataType, T.ArrayType):
        return F.col(name).cast("array<double>")
    return F.array(F.col(name).cast("double"))


def head(vector: str | Column) -> Column:
    return vector_to_array(vector)[0]


def element(vector: str | Column, i: int) -> Column:
    return vector_to_array(vector)[i]


def concat_vectors(*vectors: str) -> Column:
    return array_to_vector(F.concat(*[vector_to_array(F.col(v)) for v in vectors]))


def map_vector(vector: str, fn: Callable[[Column], Column]) -> Column:
    return array_to_vector(F.transform(vector_to_array(F.col(vector)), lambda x: fn(x)))


def map_vector_indexed(vector: str, fn: Callable[[Column, Column], Column]) -> Column:
    return array_to_vector(F.transform(vector_to_array(F.col(vector)), lambda x, i: fn(x, i)))


def argmax(array: Column) -> Column:
    """0-based place of the first maximum."""
    return (F.array_position(array, F.array_max(array)) - 1).cast("int")


def transpose_vectors(df: DataFrame, columns: list[str], order: str) -> DataFrame:
    """n rows of m-wide vectors, in ``order``, become m rows (pos, *columns) of n-wide arrays. All columns share m."""
    arrays = [as_array(df, c).alias(c) for c in columns]
    long = df.select(F.col(order).alias("_order"), F.posexplode(F.arrays_zip(*arrays)).alias("pos", "_z"))
    gathered = [F.transform(F.sort_array(F.collect_list(F.struct(F.col("_order"), F.col("_z")[c].alias("_v")))), lambda s: s["_v"]).alias(c) for c in columns]
    return long.groupBy("pos").agg(*gathered)


# --- element-wise aggregates --------------------------------------------------------------------------------------


def _per_element(df: DataFrame, column: str, by: list[str], agg: Callable[[str], Column]) -> DataFrame:
    long = df.where(F.col(column).isNotNull()).select(*by, F.posexplode(as_array(df, column)).alias("_pos", "_x"))
    each = long.groupBy(*by, "_pos").agg(agg("_x").alias("_x"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("_pos", "_x"))), lambda s: s["_x"])
    return each.groupBy(*by).agg(ordered.alias(column))


def vector_sum(df: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    return _per_element(df, column, by or [], F.sum)


def vector_max(df: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    return _per_element(df, column, by or [], F.max)


def vector_min(df: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    return _per_element(df, column, by or [], F.min)


def column_norms(df: DataFrame, column: str, p: float) -> DataFrame:
    """One row: the p-norm of each element over all rows, p >= 1 or infinity."""
    if not p >= 1:
        raise ValueError(f"p must be 1 or more, not {p}")
    if p == float("inf"):
        return _per_element(df, column, [], lambda x: F.max(F.abs(x)))
    if p == 1:
        return _summed(df, column, F.abs, lambda s: s)
    if p == 2:
        return _summed(df, column, lambda x: x * x, F.sqrt)
    return _summed(df, column, lambda x: F.pow(F.abs(x), F.lit(float(p))), lambda s: F.pow(s, F.lit(1.0 / p)))


def _summed(df: DataFrame, column: str, term: Callable[[Column], Column], last: Callable[[Column], Column]) -> DataFrame:
    """One row: ``last`` of the sum of each element's terms (none below 0), the same however rows are dealt and ordered.

    Each term is cut into three whole numbers of 31 bits below its column's largest, which add up without rounding.
    """
    long = df.where(F.col(column).isNotNull()).select(F.posexplode(as_array(df, column)).alias("_pos", "_x")).select("_pos", term(F.col("_x")).alias("_x"))
    tops = long.groupBy("_pos").agg(F.max("_x").alias("_top"))  # a row for each element
    step = F.lit(float(1 << 31))
    plain = F.isnan("_top") | (F.col("_top") > 1e300) | (F.col("_top") < 1e-250)  # cut pieces would leave the range of doubles
    bits = F.floor(F.log2("_top")) + 2
    y = long.join(F.broadcast(tops), "_pos").withColumn("_y", F.when(~plain, F.col("_x") / F.pow(F.lit(2.0), bits) * step))
    y = y.withColumn("_h", F.floor("_y")).withColumn("_y", (F.col("_y") - F.col("_h")) * step)
    y = y.withColumn("_m", F.floor("_y")).withColumn("_l", F.floor((F.col("_y") - F.col("_m")) * step))
    sums = y.groupBy("_pos", "_top").agg(*[F.sum(c).cast("decimal(38,0)").alias(c) for c in ("_h", "_m", "_l")], F.sum("_x").alias("_plain"))
    factor = F.lit(1 << 31).cast("decimal(11,0)")
    whole = ((F.col("_h") * factor + F.col("_m")).cast("decimal(38,0)") * factor + F.col("_l")).cast("double")
    exact = whole / step / step / step * F.pow(F.lit(2.0), bits)
    each = sums.select("_pos", last(F.when(plain | F.col("_top").isNull(), F.col("_plain")).otherwise(exact)).alias("_x"))
    return each.agg(F.transform(F.sort_array(F.collect_list(F.struct("_pos", "_x"))), lambda s: s["_x"]).alias(column))


# --- running folds over all elements of all vectors so far ---------------------------------------------------------


def _running(df: DataFrame, column: str, order: str, group: str | None, one: Column, agg: Callable[[Column], Column]) -> Column:
    window = (Window.partitionBy(group) if group else Window.partitionBy()).orderBy(order)
    return agg(one).over(window.rowsBetween(Window.unboundedPreceding, 0))


def running_min(df: DataFrame, column: str, order: str, group: str | None = None) -> Column:
    return _running(df, column, order, group, F.array_min(as_array(df, column)), F.min)


def running_max(df: DataFrame, column: str, order: str, group: str | None = None) -> Column:
    return _running(df, column, order, group, F.array_max(as_array(df, column)), F.max)


def running_sum(df: DataFrame, column: str, order: str, group: str | None = None) -> Column:
    return _running(df, column, order, group, F.aggregate(as_array(df, column), F.lit(0.0), lambda a, x: a + x), F.sum)
