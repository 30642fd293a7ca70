"""Metrics and curves as DataFrame aggregations."""

from __future__ import annotations

from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions.vectors import is_vector
from tidemill.operators.windows import piece_of, range_bounds, sums_before, with_rank

# The metrics' names.
CLASSIFICATION = ("f1", "weightedPrecision", "weightedRecall", "accuracy")
BINARY = ("areaUnderROC", "areaUnderPR")
REGRESSION = ("mse", "rmse", "r2", "mae")


def classification_evaluators(binary: bool, score: str = "probability") -> dict:
    found = {m: MulticlassClassificationEvaluator(metricName=m) for m in CLASSIFICATION}
    if binary:
        found |= {m: BinaryClassificationEvaluator(rawPredictionCol=score, metricName=m, numBins=0) for m in BINARY}
    return found


def regression_evaluators() -> dict:
    return {m: RegressionEvaluator(metricName=m) for m in REGRESSION}


def confusion(df: DataFrame) -> DataFrame:
    """(label, prediction, n)."""
    return df.groupBy("label", "prediction").agg(F.count("*").alias("n"))


def multiclass_metrics(df: DataFrame) -> DataFrame:
    """One row: f1, weightedPrecision, weightedRecall, accuracy; computed from the confusion matrix alone."""
    m = confusion(df)
    by_label = m.groupBy(F.col("label").alias("c")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)).alias("tp"))
    by_prediction = m.groupBy(F.col("prediction").alias("c")).agg(F.sum("n").alias("predicted"))
    j = by_label.join(by_prediction, "c", "left").fillna(0, ["predicted"])
    precision = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(0.0)
    recall = F.col("tp") / F.col("support")
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    weighted = lambda x: F.sum(x * F.col("support")) / F.sum("support")
    return j.agg(weighted(f1).alias("f1"), weighted(precision).alias("weightedPrecision"), weighted(recall).alias("weightedRecall"), (F.sum("tp") / F.sum("support")).alias("accuracy"))


def regression_metrics(df: DataFrame) -> DataFrame:
    """One row: mse, rmse, r2, mae."""
    e = F.col("label") - F.col("prediction")
    mse = F.avg(e * e)
    return df.agg(mse.alias("mse"), F.sqrt(mse).alias("rmse"), (1 - F.sum(e * e) / (F.var_pop("label") * F.count("label"))).alias("r2"), F.avg(F.abs(e)).alias("mae"))


def score_of(df: DataFrame, score: str) -> Column:
    return vector_to_array(F.col(score))[1] if is_vector(df, score) else F.col(score).cast("double")


def one_hot_prediction(df: DataFrame, score: str = "probability", classes: int = 2) -> DataFrame:
    """Where a learner gives no score: the one-hot prediction in its place, two wide even if one class is predicted."""
    if score in df.columns:
        return df
    from tidemill.operators.prep import IndexVectorizer

    return IndexVectorizer(inputCol="prediction", outputCol=score, size=classes).transform(df)


def cumulative(df: DataFrame, score: str = "score", bins: int = 0) -> DataFrame:
    """(score, hits, misses, tp, fp, p, n) for each distinct score: hits and false alarms at that score, and of all scores from it up.

    ``bins`` over 0 keeps about so many points. Rows are first summed by score; ranges of scores then count by
    themselves, and the sums of the ranges above (at most a thousand numbers) are added to each.
    """
    at = df.select(score_of(df, score).alias("score"), F.col("label").cast("double").alias("label")).groupBy("score").agg(F.sum("label").alias("hits"), F.sum(1 - F.col("label")).alias("misses"))
    at = at.withColumn("_falling", -F.col("score"))
    if bins:
        # Neighbouring scores share a point, which stands at the lowest of them.
        ranked = with_rank(at, "_falling", "_place")
        points = ranked.count()
        if not points:
            return ranked.select("score", "hits", "misses", *[F.lit(0.0).alias(c) for c in ("tp", "fp", "p", "n")])
        bin_of = F.floor((F.col("_place") - 1) * F.lit(bins) / F.lit(max(points, bins)))
        at = ranked.groupBy(bin_of).agg(F.min("score").alias("score"), F.sum("hits").alias("hits"), F.sum("misses").alias("misses"))
        at = at.select("score", "hits", "misses").withColumn("_falling", -F.col("score"))
    bounds = range_bounds(at, "_falling")
    at = at.withColumn("_piece", piece_of("_falling", bounds))
    totals = {r["_piece"]: r for r in at.groupBy("_piece").agg(F.sum("hits").alias("hits"), F.sum("misses").alias("misses")).collect()}  # a row for each piece
    hits, misses = ({k: r[c] for k, r in totals.items()} for c in ("hits", "misses"))
    so_far = Window.partitionBy("_piece").orderBy("_falling").rowsBetween(Window.unboundedPreceding, 0)
    before = lambda sums: F.get(F.array(*[F.lit(float(x)) for x in sums_before(sums, len(bounds) + 1)]), F.col("_piece"))
    at = at.withColumns({"tp": before(hits) + F.sum("hits").over(so_far), "fp": before(misses) + F.sum("misses").over(so_far)})
    return at.select("score", "hits", "misses", "tp", "fp", F.lit(float(sum(hits.values()))).alias("p"), F.lit(float(sum(misses.values()))).alias("n"))


def roc_curve(df: DataFrame, score: str = "score", bins: int = 0) -> DataFrame:
    """(x, y): false and true positive rates from (0, 0) to (1, 1)."""
    points = cumulative(df, score, bins).select((F.col("fp") / F.col("n")).alias("x"), (F.col("tp") / F.col("p")).alias("y"))
    ends = df.sparkSession.createDataFrame([(0.0, 0.0), (1.0, 1.0)], "x double, y double")
    return points.unionByName(ends)


def pr_curve(df: DataFrame, score: str = "score", bins: int = 0) -> DataFrame:
    """(x, y): recall and precision; the first point repeats the first precision at recall 0."""
    points = cumulative(df, score, bins)
    y = F.col("tp") / (F.col("tp") + F.col("fp"))
    first = points.orderBy(F.desc("score")).limit(1).select(F.lit(0.0).alias("x"), y.alias("y"))
    return points.select((F.col("tp") / F.col("p")).alias("x"), y.alias("y")).unionByName(first)


def threshold_curves(df: DataFrame, score: str = "score", bins: int = 0) -> DataFrame:
    """(threshold, precision, recall, f1)."""
    c = cumulative(df, score, bins)
    precision, recall = F.col("tp") / (F.col("tp") + F.col("fp")), F.col("tp") / F.col("p")
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    return c.select(F.col("score").alias("threshold"), precision.alias("precision"), recall.alias("recall"), f1.alias("f1"))


def areas(df: DataFrame, score: str = "score") -> DataFrame:
    """One row: areaUnderROC and areaUnderPR by trapezoids."""
    c = cumulative(df, score)
    before_tp, before_fp = F.col("tp") - F.col("hits"), F.col("fp") - F.col("misses")
    precision = F.col("tp") / (F.col("tp") + F.col("fp"))
    before = F.when(before_tp + before_fp > 0, before_tp / (before_tp + before_fp)).otherwise(precision)
    roc = F.col("misses") / F.col("n") * (F.col("tp") + before_tp) / F.col("p") / 2
    return c.agg(F.sum(roc).alias("areaUnderROC"), F.sum(F.col("hits") / F.col("p") * (precision + before) / 2).alias("areaUnderPR"))


def consistent_scores(df: DataFrame, tolerance: float = 0.001) -> bool:
    """Whether probability and rawPrediction rank alike: their areas agree within ``tolerance``."""
    a, b = (areas(df, s).first() for s in ("probability", "rawPrediction"))
    return all(abs(a[m] - b[m]) <= tolerance * max(abs(a[m]), 1e-12) for m in BINARY)


def metric_stats(metrics: DataFrame) -> DataFrame:
    """(metric, split, mean, min, max, variance, median) of a long table (metric, repetition, split, value); the variance of one value is 0."""
    v = F.col("value")
    return metrics.groupBy("metric", "split").agg(F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"), F.coalesce(F.var_samp(v), F.lit(0.0)).alias("variance"), F.median(v).alias("median"))
