import duckdb
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from tidemill.operators.scaling import transformed, vector_scaler
from tidemill.plans.registry import rounded, rounded_array

SQL = {
    "MinMaxPlusMinusOneScaler": "SELECT k, CAST(round((x - a) / (b - a) * 2 - 1, 6) AS VARCHAR) FROM t, (SELECT min(x) AS a, max(x) AS b FROM t)",
    "MinMaxZeroOneScaler": "SELECT k, CAST(round((x - a) / (b - a), 6) AS VARCHAR) FROM t, (SELECT min(x) AS a, max(x) AS b FROM t)",
    "StandardScaler": "SELECT k, CAST(round((x - a) / b, 6) AS VARCHAR) FROM t, (SELECT avg(x) AS a, stddev_samp(x) AS b FROM t)",
}


@pytest.mark.parametrize("kind", SQL)
def test_scaled_columns_equal_sql_on_ties(spark, tmp_path, kind):
    """Prices in cents over a range of 10,400,000 of them: many scaled values end in a half of the sixth place."""
    step = 13 if kind.startswith("MinMax") else 2600  # few enough that both sums round alike
    spark.range(0, 10_400_001, step).select("id", (F.col("id") / 100 + 900).alias("x")).write.parquet(f"file://{tmp_path}/t")
    df = spark.read.parquet(f"file://{tmp_path}/t")
    out = transformed(vector_scaler(kind, "v", "s"), df.withColumn("v", array_to_vector(F.array("x")))).select("id", rounded_array(vector_to_array("s"))[0].alias("x"))
    out.write.parquet(f"file://{tmp_path}/out")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW t AS SELECT id AS k, x FROM '{tmp_path}/t/*.parquet'")
    differ = c.execute(f"SELECT count(*) FROM ({SQL[kind]}) w(k, x) JOIN '{tmp_path}/out/*.parquet' g ON w.k = g.id WHERE w.x <> CAST(g.x AS VARCHAR)").fetchone()[0]
    assert differ == 0


def test_a_small_negative_rounds_to_the_negative_zero_of_the_sql(spark):
    df = spark.createDataFrame([(0, -1.0), (1, -1e-9), (2, 1.0 + 1e-9)], "k int, x double").withColumn("v", array_to_vector(F.array("x")))
    out = transformed(vector_scaler("StandardScaler", "v", "s"), df).select("k", rounded_array(vector_to_array("s"))[0].alias("x"))
    assert [str(r["x"]) for r in out.orderBy("k").collect()] == ["-1.0", "-0.0", "1.0"]


def test_rounding_is_that_of_the_sql(spark):
    values = [0.0, -0.0, -1e-9, 1e-9, 0.5e-6, -0.5e-6, 1.0000005, 2.0000015, 1.0000025, 0.1234565, -7.1234575, 1e300, -1.7e308, float("inf"), float("nan"), 1906272127415.8295] + [k / 2e6 + k // 7 for k in range(1, 400, 2)]
    got = [str(r[0]) for r in spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double").orderBy("k").select(rounded("v")).collect()]
    c = duckdb.connect()
    want = [str(c.execute("SELECT round(?::DOUBLE, 6)", [v]).fetchone()[0]) for v in values]
    assert got == want
