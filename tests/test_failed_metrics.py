import pytest
from pyspark.ml.evaluation import RegressionEvaluator

from tidemill.errors import TidemillError
from tidemill.operators.service import evaluate_safely


def test_a_metric_that_fails_is_no_result(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 3.0)], "label double, prediction double")
    evaluators = {"mae": RegressionEvaluator(metricName="mae"), "other": RegressionEvaluator(metricName="mae", predictionCol="missing")}
    with pytest.raises(TidemillError, match="other of the test rows"):
        evaluate_safely(evaluators, {"test": df})
    assert evaluate_safely({"mae": evaluators["mae"]}, {"test": df, "replication": df.limit(0)}) == {"mae": {"test": 0.5}}
