import math

import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tidemill.functions import vectors


def test_norms_do_not_depend_on_the_order_of_rows(spark):
    """A large term first or last: the small ones beside it must not be lost."""
    df = spark.range(4000, numPartitions=1).select(array_to_vector(F.array(F.when(F.col("id") == 0, 1e16).otherwise(1.0), F.col("id") * 0.1, F.lit(0.0), F.lit(-1e-300))).alias("v"))
    want = [[1e16, *[1.0] * 3999], [k * 0.1 for k in range(4000)], [0.0]]
    got = vectors.column_norms(df, "v", 1).first()[0]
    assert got[:3] == [math.fsum(w) for w in want] and got[3] == pytest.approx(4e-297)
    got = vectors.column_norms(df, "v", 2).first()[0]
    assert got[:3] == [math.sqrt(math.fsum(x * x for x in w)) for w in want]
    assert vectors.column_norms(df.limit(0), "v", 1).first()[0] == []
