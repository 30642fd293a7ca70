import math

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tidemill.operators.reservoir import Network, ReservoirSpec, ReservoirStates, reservoir
from tidemill.operators.service import binary_curves
from tidemill.operators.stages import Keep
from tidemill.operators.windows import range_bounds


def test_states_are_the_written_out_sums_to_the_last_bit():
    net = Network(ReservoirSpec(nodes=3, spectral_radius=0.8, reservoir_bias=True), 2, 5)
    u = np.random.default_rng(1).normal(size=(400, 2))
    x, want = net.initial.tolist(), []
    for row in u.tolist():
        y = []
        for i in range(3):
            total = row[0] * net.w_in[i, 0] + row[1] * net.w_in[i, 1]
            for k in range(3):
                total = total + net.w[i, k] * x[k]
            y.append(math.tanh(total + net.w_bias[i]))
        x = y
        want.append(x)
    assert net.states(u).tolist() == want
    assert net.states(u[200:], net.states(u[:200])[-1]).tolist() == want[200:]


@pytest.mark.parametrize("spec", [ReservoirSpec(nodes=4, spectral_radius=0.9), ReservoirSpec(nodes=3, spectral_radius=1.0, function="Linear"), ReservoirSpec(nodes=3, spectral_radius=0.9, function="Sin")])
def test_one_series_runs_in_pieces_as_if_in_one(spark, spec):
    u = np.random.default_rng(2).normal(size=(600, 2))
    df = spark.createDataFrame([(k, [float(a) for a in u[k]]) for k in range(600)], "o int, u array<double>")
    out = ReservoirStates(inputCol="u", outputCol="x", orderCol="o", spec=ReservoirStates.spec_json(spec), seed=3).transform(df)
    got = {r["o"]: list(r["x"]) for r in out.select("o", vector_to_array("x").alias("x")).collect()}
    assert [got[k] for k in range(600)] == Network(spec, 2, 3).states(u).tolist()
    plan = out._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan and "RoundRobinPartitioning(1)" not in plan
    assert len(range_bounds(df, "o")) > 1 and "CASE WHEN" in plan


def test_washout_needs_no_second_run(spark):
    df = spark.createDataFrame([(k, float(k)) for k in range(5, 60)], "o int, u double")
    out = reservoir("u", "o", "x", ReservoirSpec(nodes=3, washout=7)).fit(df).transform(df)
    assert sorted(r["o"] for r in out.collect()) == list(range(13, 60))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_curves_are_collected_when_looked_at(spark):
    df = spark.createDataFrame([(0.3, 0.0), (0.7, 1.0)], "score double, label double")
    curves = binary_curves(df.withColumn("label", F.raise_error(F.lit("asked for")).cast("double")), "score", 0)
    with pytest.raises(Exception, match="asked for"):
        len(curves["roc"])
    curves = binary_curves(df, "score", 0)
    assert curves["roc"] == [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (1.0, 1.0)] and curves["recallThreshold"] == [(0.7, 1.0), (0.3, 1.0)]


def test_kept_frames_are_few(spark):
    keep = Keep()
    frames = [keep.copy().transform(spark.range(k + 1)) for k in range(6)]
    assert [f.storageLevel.useMemory for f in frames] == [False] * 2 + [True] * 4
    keep.drop()
    assert not any(f.storageLevel.useMemory for f in frames)
