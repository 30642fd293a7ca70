import math
import random

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tidemill.errors import TidemillError
from tidemill.functions import vectors
from tidemill.operators import learners as L
from tidemill.operators import metrics as M
from tidemill.operators import windows
from tidemill.operators.prep import BooleanLabelIndexer, FixedOrderStringIndexer, IndexToStringIfNeeded, IndexVectorizer, VectorHead, index_strings, input_size, join_by_order, output_size, prepare_features
from tidemill.operators.reservoir import Network, ReservoirSpec, ReservoirStates, reservoir
from tidemill.operators.results import ClassificationSetting, IOSpec, RegressionSetting, Results, RunResult, RunSpec, ServiceSetting, TemporalSetting
from tidemill.operators.sampling import Sampling, choose_split, forward_chain_splits, random_split, seq_split
from tidemill.operators.scaling import ColumnNormNormalizer, in_place_pca, numeric_scaler_in_place, transformed, vector_scaler, vector_scaler_in_place
from tidemill.operators.service import LearningService, kernel_size
from tidemill.operators.stages import Apply, DropSeriesLeft, FilterGroupsWithCount
from tidemill.operators.validation import ForwardChainingCrossValidator, ForwardChainingCrossValidatorModel, best_of
from tidemill.operators.windows import SeqShift, SlidingWindow
from tidemill.sources import csv, plots


def series(spark, values, orders=None):
    return spark.createDataFrame(list(zip(orders or range(len(values)), values, strict=True)), "o int, v double")


def got(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


# --- windows ------------------------------------------------------------------------------------------------------


def test_sliding_window_drops_short_and_null_windows(spark):
    df = series(spark, [1.0, 2.0, None, 4.0, 5.0, 6.0])
    w = SlidingWindow(inputCol="v", outputCol="w", orderCol="o", windowSize=2)
    assert got(w.transform(df), "o", "w") == [(1, [1.0, 2.0]), (4, [4.0, 5.0]), (5, [5.0, 6.0])]
    assert w.transform(df.limit(0)).count() == 0
    with pytest.raises(TidemillError):
        SlidingWindow(inputCol="v", outputCol="w", orderCol="o", windowSize=0).transform(df)
    with pytest.raises(TidemillError):
        SlidingWindow(inputCol="v", outputCol="v2", orderCol="missing", windowSize=2).transform(df)
    with pytest.raises(TidemillError):
        SlidingWindow(inputCol="v", outputCol="o", orderCol="o", windowSize=2).transform(df)


def test_sliding_window_of_mixed_vectors_in_place(spark):
    df = spark.createDataFrame([(0, Vectors.dense(1, 2)), (1, Vectors.sparse(2, [1], [3.0])), (2, Vectors.dense(5, 6))], ["o", "v"])
    out = SlidingWindow(inputCol="v", outputCol="v", orderCol="o", windowSize=2).transform(df)
    assert out.columns == ["o", "v"]
    assert [(r["o"], r["v"].toArray().tolist()) for r in out.orderBy("o").collect()] == [(1, [1, 2, 0, 3]), (2, [0, 3, 5, 6])]


def test_blocks_borrow_what_windows_reach(spark):
    rng = random.Random(1)
    orders = sorted(rng.sample(range(500), 60))
    df = series(spark, [float(x) for x in orders], orders)
    for n in (1, 2, 4, 7):
        blocks = lambda d, o, b, a: windows.blocks(d, o, b, a, 3)
        rows, w, own = blocks(df, "o", n - 1, 0)
        out = rows.withColumn("w", F.collect_list("v").over(w.rowsBetween(1 - n, 0))).where(own & (F.size("w") == n))
        assert got(out, "o", "w") == [(orders[k], [float(x) for x in orders[k - n + 1 : k + 1]]) for k in range(n - 1, 60)]
        rows, w, own = blocks(df, "o", 0, n)
        out = rows.withColumn("x", F.lead("v", n).over(w)).where(own & F.col("x").isNotNull())
        assert got(out, "o", "x") == [(orders[k], float(orders[k + n])) for k in range(60 - n)]


def test_consecutive_windows_equal_joins_on_gaps(spark):
    orders = [0, 1, 2, 5, 6, 7, 8, 11]
    df = series(spark, [float(x) for x in orders], orders)
    a = SlidingWindow(inputCol="v", outputCol="w", orderCol="o", windowSize=3, consecutive=True).transform(df)
    b = SlidingWindow(inputCol="v", outputCol="w", orderCol="o", windowSize=3, consecutive=True, duplicates=True).transform(df)
    want = [(2, [0, 1, 2]), (7, [5, 6, 7]), (8, [6, 7, 8])]
    for x in (a, b):
        assert [(r["o"], r["w"].toArray().tolist()) for r in x.orderBy("o").collect()] == want
    twice = df.union(df.where("o = 1"))
    out = SlidingWindow(inputCol="v", outputCol="w", orderCol="o", windowSize=2, consecutive=True, duplicates=True).transform(twice)
    assert out.where("o <= 2").count() == 4


def test_shifts(spark):
    df = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 2.0), ("a", 2, 3.0), ("b", 0, 10.0)], "g string, o int, v double")
    strict = SeqShift(inputCol="v", outputCol="x", orderCol="o", groupCol="g", shift=1)
    assert got(strict.transform(df), "g", "o", "x") == [("a", 0, 2.0), ("a", 1, 3.0)]
    compat = SeqShift(inputCol="v", outputCol="x", orderCol="o", groupCol="g", shift=1, mode="compat")
    assert got(compat.transform(df), "g", "o", "x") == [("a", 0, 2.0), ("a", 1, 3.0), ("b", 0, 10.0)]
    gaps = series(spark, [0.0, 1.0, 3.0], [0, 1, 3])
    assert got(SeqShift(inputCol="v", outputCol="x", orderCol="o", shift=2, consecutive=True).transform(gaps), "o", "x") == [(1, 3.0)]
    assert got(SeqShift(inputCol="v", outputCol="v", orderCol="o", shift=2).transform(gaps), "o", "v") == [(0, 3.0)]


def test_filters(spark):
    df = series(spark, [1.0, 2.0, 3.0, 4.0], [5, 6, 7, 9])
    assert [r[0] for r in got(DropSeriesLeft(orderCol="o", count=0).transform(df), "o")] == [6, 7, 9]
    assert DropSeriesLeft(orderCol="o", count=0).transform(df.limit(0)).count() == 0
    with pytest.raises(TidemillError):
        DropSeriesLeft(orderCol="o").transform(df)
    people = spark.createDataFrame([(n, k) for n, c in (("Peter", 3), ("John", 3), ("Cecilia", 3), ("Zuzana", 2), ("Robert", 2), (None, 3)) for k in range(c)], "name string, k int")
    out = FilterGroupsWithCount(groupCol="name", expectedCount=3).transform(people)
    assert out.count() == 12 and {r["name"] for r in out.collect()} == {"Peter", "John", "Cecilia", None}


# --- preparation --------------------------------------------------------------------------------------------------


def test_prepare_features(spark):
    df = spark.createDataFrame([(1.0, 2.0, "x"), (3.0, None, "y")], "a double, b double, c string")
    out = prepare_features(df, {"b", "a", "zz"}, "a")
    assert out.columns == ["c", "features", "label"] or set(out.columns) == {"c", "features", "label"}
    assert out.first()["features"].toArray().tolist() == [1.0, 2.0] and out.first()["label"] == 1.0 and out.count() == 1
    assert input_size(out) == 2


def test_indexers(spark):
    df = spark.createDataFrame([("x",), ("y",), ("y",), ("z",)], "c string")
    assert sorted(r["c"] for r in index_strings(df, [("c", None)]).collect()) == [0.0, 0.0, 1.0, 2.0]
    assert sorted(r["c"] for r in index_strings(df, [("c", ["z", "y"])]).collect()) == [0.0, 1.0, 1.0]
    with pytest.raises(TidemillError):
        FixedOrderStringIndexer(inputCol="c", outputCol="i", labels=[]).fit(df)
    flags = spark.createDataFrame([(True,), (False,), (None,)], "label boolean")
    out = BooleanLabelIndexer(stringLabelCol="s").transform(flags)
    assert got(out, "label", "s") == [(0.0, "false"), (1.0, "true")] and output_size(out) == 2
    assert got(IndexToStringIfNeeded(inputCol="label", outputCol="back").transform(out), "back") == [("false",), ("true",)]
    assert IndexToStringIfNeeded(inputCol="label", outputCol="s").transform(out).columns == out.columns


def test_vectorizer_and_head(spark):
    df = spark.createDataFrame([(0,), (2,)], "i int")
    out = IndexVectorizer(inputCol="i", outputCol="h").transform(df)
    assert sorted(r["h"].toArray().tolist() for r in out.collect()) == [[0, 0, 1], [1, 0, 0]]
    with pytest.raises(Exception, match="not a category"):
        IndexVectorizer(inputCol="i", outputCol="h").transform(spark.createDataFrame([(-1,)], "i int")).collect()
    assert got(VectorHead(inputCol="h", outputCol="x").transform(out), "i", "x") == [(0, 1.0), (2, 0.0)]
    assert VectorHead(inputCol="h", outputCol="i").transform(out).columns == out.columns


def test_vector_functions(spark):
    df = spark.createDataFrame([(0, Vectors.dense(1, 5)), (1, Vectors.sparse(2, [0], [-3.0])), (2, None)], ["o", "v"])
    df = df.where("v IS NOT NULL")
    assert vectors.vector_sum(df, "v").first()[0] == [-2, 5] and vectors.vector_max(df, "v").first()[0] == [1, 5] and vectors.vector_min(df, "v").first()[0] == [-3, 0]
    assert got(vectors.transpose_vectors(df, ["v"], "o"), "pos", "v") == [(0, [1, -3]), (1, [5, 0])]
    assert vectors.column_norms(df, "v", 1).first()[0] == [4, 5] and vectors.column_norms(df, "v", math.inf).first()[0] == [3, 5]
    assert vectors.column_norms(df, "v", 3).first()[0] == pytest.approx([28 ** (1 / 3), 5])
    with pytest.raises(ValueError, match="p must"):
        vectors.column_norms(df, "v", 0.5)
    assert [r[0] for r in df.select(vectors.running_min(df, "v", "o")).collect()] == [1, -3]


def test_join_by_order_and_apply(spark):
    a, b = series(spark, [1.0, 2.0, 3.0], [9, 7, 8]), spark.createDataFrame([(30,), (10,)], "k int")
    assert got(join_by_order(a, b, "o", "k"), "o", "k") == [(7, 10), (8, 30)]
    assert Apply(lambda d: d.where("k > 10")).transform(b).count() == 1
    with pytest.raises(TidemillError):
        Apply(lambda d: d.withColumn("x", F.lit(1))).transform(b)


# --- scaling ------------------------------------------------------------------------------------------------------


def test_scalers_on_constant_and_zero_columns(spark):
    df = spark.createDataFrame([(Vectors.dense(1, 2, 0),), (Vectors.dense(3, 2, 0),)], ["features"])
    want = {"L1Normalizer": [0.25, 0.5, 0], "L2Normalizer": [1 / math.sqrt(10), 2 / math.sqrt(8), 0], "StandardScaler": [-1 / math.sqrt(2), 0, 0], "MinMaxPlusMinusOneScaler": [-1, 0, 0], "MinMaxZeroOneScaler": [0, 0.5, 0.5], "MaxAbsScaler": [1 / 3, 1, 0]}
    for kind, first in want.items():
        rows = sorted(r["x"].toArray().tolist() for r in transformed(vector_scaler(kind, "features", "x"), df).collect())
        assert rows[0] == pytest.approx(first), kind
    assert transformed(vector_scaler_in_place("MaxAbsScaler"), df).columns == ["features"]
    assert transformed(in_place_pca(2), df).first()["features"].size == 2
    labels = series(spark, [1.0, 3.0])
    assert got(transformed(numeric_scaler_in_place("MinMaxZeroOneScaler", "v"), labels), "v") == [(0.0,), (1.0,)]
    with pytest.raises(TidemillError):
        vector_scaler("other")


def test_pipelines_are_written_and_read(spark, tmp_path):
    df = spark.createDataFrame([(k, Vectors.dense(k, 1)) for k in range(6)], ["o", "v"])
    model = Pipeline(stages=[ColumnNormNormalizer(inputCol="v", outputCol="n", p=3.0), SlidingWindow(inputCol="n", outputCol="w", orderCol="o", windowSize=2)]).fit(df)
    model.write().overwrite().save(f"file://{tmp_path}/m")
    again = PipelineModel.load(f"file://{tmp_path}/m")
    assert [r["w"] for r in again.transform(df).orderBy("o").collect()] == [r["w"] for r in model.transform(df).orderBy("o").collect()]


# --- splits and samples -------------------------------------------------------------------------------------------


def test_splits(spark):
    df = series(spark, [float(x) for x in range(100)])
    a, b = random_split(df, 0.7, 1)
    assert a.count() + b.count() == 100
    head, tail = seq_split(df, "o", 0.8, 0.0)
    assert (head.count(), tail.count()) == (80, 20)
    assert choose_split("o", 0.5, 9)(df)[0].count() == 10
    with pytest.raises(TidemillError):
        choose_split("o")
    with pytest.raises(TidemillError):
        seq_split(df, "missing")
    folds = forward_chain_splits(df, "o", 3, err=0.0)
    assert [tuple(x.count() for x in f) for f in folds] == [(25, 25, 50), (50, 25, 75), (75, 25, 100)]


def test_sampling(spark):
    rows = [("a",)] * 1000 + [("b",)] * 10 + [(None,)] * 5
    df = spark.createDataFrame(rows, "labelString string").withColumn("labelString", F.col("labelString").alias("labelString", metadata={"ml_attr": {"aliases": {"from": ["alias"], "to": ["a"]}}}))
    n = {r[0]: r[1] for r in Sampling.of([("alias", 0.3)], 3).transform(df).groupBy("labelString").count().collect()}
    assert n["b"] == 10 and None not in n and 230 < n["a"] < 370
    assert Sampling(ratios="{}", training=False).transform(df).count() == 1015


# --- metrics ------------------------------------------------------------------------------------------------------


def test_metrics_agree_with_the_library(spark):
    rng = random.Random(5)
    rows = [(float(rng.random() < 0.4), Vectors.dense(1 - p, p), float(p > 0.5)) for p in (round(rng.random(), 2) for _ in range(300))]
    df = spark.createDataFrame(rows, ["label", "probability", "prediction"])
    mine, areas = M.multiclass_metrics(df).first(), M.areas(df, "probability").first()
    for name, e in M.classification_evaluators(True).items():
        assert e.evaluate(df) == pytest.approx((areas if name in M.BINARY else mine)[name], abs=1e-9), name
    lines = spark.createDataFrame([(float(k), k * 0.9 + 1) for k in range(20)], "label double, prediction double")
    one = M.regression_metrics(lines).first()
    for name, e in M.regression_evaluators().items():
        assert e.evaluate(lines) == pytest.approx(one[name])
    assert M.roc_curve(df, "probability", bins=10).count() == 12
    zero = M.one_hot_prediction(spark.createDataFrame([(0.0,)], "prediction double"))
    assert zero.first()["probability"].toArray().tolist() == [1.0, 0.0]
    stats = M.metric_stats(spark.createDataFrame([("m", 0, "test", 2.0)], "metric string, repetition int, split string, value double")).first()
    assert stats["variance"] == 0.0 and stats["median"] == 2.0


# --- reservoir ----------------------------------------------------------------------------------------------------


def test_network_steps_by_hand():
    net = Network(ReservoirSpec(nodes=2, spectral_radius=0.5), 1, 3)
    assert np.abs(np.linalg.eigvals(net.w)).max() == pytest.approx(0.5)
    net.w, net.w_in, net.w_bias = np.array([[0.0, 0.5], [0.25, 0.0]]), np.array([[1.0], [-1.0]]), np.zeros(2)
    s = net.states(np.array([[1.0], [0.5]]))
    assert s[0] == pytest.approx(np.tanh([1, -1]))
    assert s[1] == pytest.approx(np.tanh([0.5 + 0.5 * np.tanh(-1), -0.5 + 0.25 * np.tanh(1)]))


def test_reservoir_states(spark):
    df = spark.createDataFrame([("a", 0, Vectors.dense(1.0)), ("a", 1, Vectors.dense(2.0)), ("a", 1, Vectors.dense(3.0)), ("b", 0, Vectors.dense(1.0))], ["g", "o", "v"])
    spec = ReservoirSpec(nodes=4, in_degree=2, spectral_radius=0.9)
    stage = ReservoirStates(inputCol="v", outputCol="s", orderCol="o", groupCol="g", spec=ReservoirStates.spec_json(spec))
    rows = stage.transform(df).orderBy("g", "o").collect()
    assert rows[0]["s"] == rows[3]["s"] and rows[1]["s"] == rows[2]["s"] != rows[0]["s"]
    assert [r["s"] for r in stage.copy().transform(df).orderBy("g", "o").collect()] == [r["s"] for r in rows]
    out = reservoir("v", "o", "s", ReservoirSpec(nodes=3, washout=0)).fit(df).transform(df)
    assert out.count() == 2
    for spec in (ReservoirSpec(nodes=5, circular_in_edges=(1,)), ReservoirSpec(nodes=5, edges=7), ReservoirSpec(nodes=5, in_degree=2, preferential_attachment=True, allow_self_edges=False), ReservoirSpec(nodes=5, in_degree_distribution=("uniform", 1, 3), allow_multi_edges=True)):
        assert np.isfinite(Network(spec, 2, 1).states(np.ones((3, 2)))).all()


# --- learners and service -----------------------------------------------------------------------------------------


def test_specs_build_their_estimators():
    est, grids = L.build_estimator(L.LogisticRegression(regularization=L.Grid(0.1, 0.2), max_iteration=7))
    assert est.getMaxIter() == 7 and [p.name for p in grids] == ["regParam"] and len(L.param_maps(grids)) == 2
    assert L.build_estimator(L.MultiLayerPerceptron(hidden_layers=(5,)), 4, 3)[0].getLayers() == [4, 5, 3]
    for spec in L.ESTIMATORS:
        if spec is not L.MultiLayerPerceptron:
            L.build_estimator(spec())
    with pytest.raises(TidemillError):
        L.build_estimator(L.MultiLayerPerceptron())
    with pytest.raises(TidemillError):
        L.build_estimator(L.KMeans(k=L.Grid(2, 3)))


def line(spark, n=120):
    df = spark.createDataFrame([(k, float(k % 7), 2.0 * (k % 7) + 1) for k in range(n)], "index int, x double, y double")
    return prepare_features(df, {"x"}, "y").select("index", "features", "label")


def test_regression_service(spark):
    service = LearningService(ServiceSetting(seed=1))
    res = service.regress(line(spark), L.LinearRegression(), RegressionSetting(repetitions=2, collect_outputs=True), replication=line(spark, 20))
    stats = res.stats()
    assert stats["rmse"]["test"].mean < 1e-6 and stats["rmse"]["replication"] is not None and len(res.counts) == 2
    assert len(res.outputs[0]["test"]) == res.counts[0][1]
    run = RunResult.of(RunSpec(IOSpec(["b", "a"], "y"), "m", RegressionSetting()), res)
    assert run.spec.io.input_fields == ["a", "b"]
    with pytest.raises(TidemillError):
        service.regress(line(spark), L.LinearRegression(regularization=L.Grid(0.1, 1.0)), RegressionSetting())
    with pytest.raises(TidemillError):
        Results(metrics={"rmse": [{"test": 1.0}]}).stats()


def test_sampling_thins_training_rows_only(spark):
    rows = [(float(k % 2), Vectors.dense(k % 2 + (k % 5) / 10)) for k in range(200)]
    df = index_strings(spark.createDataFrame(rows, ["y", "features"]).withColumn("label", F.col("y").cast("string")).drop("y"), [("label", ["0.0", "1.0"])])
    setting = ClassificationSetting(sampling_ratios=[("1.0", 0.5)], collect_outputs=True)
    res = LearningService(ServiceSetting(seed=2)).classify(df, L.LogisticRegression(max_iteration=5), setting)
    assert len(res.outputs[0]["test"]) == res.counts[0][1] and len(res.outputs[0]["training"]) == res.counts[0][0]
    assert res.curves[0]["test"]["roc"][0] == (0.0, 0.0) and res.stats()["areaUnderROC"]["test"].mean == 1.0


def test_temporal_service_and_kernel_sizes(spark):
    setting = TemporalSetting(core=RegressionSetting(split_ratio=0.8), sliding_window=7)
    res = LearningService().regress_time_series(line(spark), L.LinearRegression(), setting)
    assert res.stats()["rmse"]["test"].mean < 1e-3
    assert kernel_size(setting, 3) == 21 and kernel_size(TemporalSetting(reservoir=ReservoirSpec(nodes=9)), 3) == 9
    assert kernel_size(TemporalSetting(sliding_window=L.Grid(2, 3)), 3) is None
    with pytest.raises(TidemillError):
        LearningService().regress_time_series(line(spark), L.LinearRegression(), TemporalSetting(core=RegressionSetting(split_ratio=0.8), reservoir=ReservoirSpec(), group_col="g"))


def test_forward_validator_chooses_and_persists(spark, tmp_path):
    df = line(spark)
    lr, _ = L.build_estimator(L.LinearRegression())
    cv = ForwardChainingCrossValidator(Pipeline(stages=[lr]), [{lr.regParam: 100.0}, {lr.regParam: 0.0}], RegressionEvaluator(metricName="rmse"), "index", folds=2, err=0.0)
    model = cv.fit(df)
    assert model.bestIndex == 1 and model.avgMetrics[0] > model.avgMetrics[1]
    model.save(f"file://{tmp_path}/cv")
    again = ForwardChainingCrossValidatorModel.load(f"file://{tmp_path}/cv")
    assert again.avgMetrics == model.avgMetrics and again.transform(df).count() == 120
    Pipeline(stages=[cv]).write().overwrite().save(f"file://{tmp_path}/whole")
    read = Pipeline.load(f"file://{tmp_path}/whole").getStages()[0]
    assert read.uid == cv.uid and read.folds == 2 and [list(m.values()) for m in read.maps] == [[100.0], [0.0]]
    assert read.fit(df).avgMetrics == model.avgMetrics
    assert best_of([float("nan"), 2.0, 1.0], True) == 1 and best_of([float("inf"), 2.0, 1.0], False) == 2
    with pytest.raises(TidemillError):
        best_of([float("nan")], True)
    with pytest.raises(TidemillError):
        ForwardChainingCrossValidator(Pipeline(stages=[lr]), [], RegressionEvaluator(), "index", process=lambda d: d).save(f"file://{tmp_path}/no")


def test_ranks_and_curves_in_pieces(spark, monkeypatch):


    rng = random.Random(1)
    rows = [(i, float(rng.randrange(60)), float(rng.random() < 0.4)) for i in range(3_000)]
    df = spark.createDataFrame(rows, "i long, score double, label double")
    monkeypatch.setattr(windows, "PIECE_ROWS", 10)
    ranked = windows.with_rank(df, "score", "r", 100).collect()
    assert sorted(r["r"] for r in ranked) == list(range(1, 3_001))
    assert [r["score"] for r in sorted(ranked, key=lambda r: r["r"])] == sorted(s for _, s, _ in rows)
    points, hits, total = [], 0, sum(y for *_, y in rows)
    for s in sorted({s for _, s, _ in rows}, reverse=True):
        hits += sum(y for _, x, y in rows if x == s)
        points.append((s, hits))
    got = M.cumulative(df).orderBy(F.desc("score")).collect()
    assert [(r["score"], r["tp"]) for r in got] == points and {r["p"] for r in got} == {total}
    plan = M.cumulative(df)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    assert 5 <= M.cumulative(df, bins=7).count() <= 7 and M.cumulative(df, bins=500).count() == len(points)
    assert M.cumulative(df.limit(0)).count() == 0 and M.cumulative(df.limit(0), bins=3).count() == 0
    scored = df.select("label", array_to_vector(F.array(1 - F.col("score") / 60, F.col("score") / 60)).alias("probability"), array_to_vector(F.array(-F.col("score"), F.col("score"))).alias("rawPrediction"))
    assert M.consistent_scores(scored) and not M.consistent_scores(scored.withColumn("rawPrediction", array_to_vector(F.array(F.lit(0.0), F.col("label")))))


def test_reservoir_states_stream_over_batches(spark):
    spec = ReservoirSpec(nodes=4, spectral_radius=0.9, weights=("normal", 0.0, 1.0))
    rows = [(g, o // 2 if g else o, float(o % 5), "x") for g in (0, 1) for o in range(90)]
    df = spark.createDataFrame(rows, "g long, o long, u double, other string")
    stage = ReservoirStates(inputCol="u", outputCol="x", orderCol="o", groupCol="g", spec=ReservoirStates.spec_json(spec), seed=3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = stage.transform(df).select("g", "o", "other", vector_to_array("x").alias("x")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 180 and {r["other"] for r in got} == {"x"}
    net = Network(spec, 1, 3)
    plain = net.states(np.array([[float(o % 5)] for o in range(90)]))
    for r in got:
        if r["g"] == 0:
            assert np.allclose(r["x"], plain[r["o"]])
    ties = {r["o"]: [x["x"] for x in got if x["g"] == 1 and x["o"] == r["o"]] for r in got if r["g"] == 1}
    assert all(len(v) == 2 and v[0] == v[1] for v in ties.values())


def test_app_shell_and_http_csv(spark, tmp_path):
    import http.server
    import threading

    (tmp_path / "a.csv").write_text("x,y\n1,a\n2,b\n")
    handler = type("Quiet", (http.server.SimpleHTTPRequestHandler,), {"log_message": lambda *a: None, "translate_path": lambda self, p: str(tmp_path / "a.csv")})
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        got = csv.remote_csv(spark, f"http://127.0.0.1:{server.server_port}/a.csv")
        assert got.dtypes == [("x", "int"), ("y", "string")] and got.count() == 2
    finally:
        server.shutdown()

    class Session:
        stopped = 0
        sparkContext = type("C", (), {"cancelAllJobs": lambda self: None})()

        def stop(self):
            Session.stopped += 1

    import time

    from tidemill import session

    with pytest.MonkeyPatch.context() as m:
        m.setattr(session, "build_session", lambda name, conf: Session())
        assert session.run_app(lambda s: 5) == 5
        with pytest.raises(TidemillError):
            session.run_app(lambda s: time.sleep(1), wait_seconds=0.05)
        with pytest.raises(ZeroDivisionError):
            session.run_app(lambda s: 1 / 0)
    assert Session.stopped == 3


def test_clusters(spark):
    df = spark.createDataFrame([(Vectors.dense(x, x),) for x in (0.0, 0.1, 9.0, 9.1)], ["features"])
    for spec in (L.KMeans(k=2, seed=1), L.BisectingKMeans(k=2, seed=1), L.GaussianMixture(k=2, seed=1)):
        c = [r["cluster"] for r in LearningService().cluster(df, spec).orderBy(F.element_at(vector_to_array("features"), 1)).collect()]
        assert c[0] == c[1] != c[2] == c[3]
    assert set(LearningService().cluster(df.select(array_to_vector(F.transform(vector_to_array("features"), lambda x: x + 1)).alias("features")), L.LDA(k=2, seed=1)).columns) >= {"features", "cluster"}


# --- sources and plots --------------------------------------------------------------------------------------------


def test_csv_and_plots(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,a\n2,b\n")
    assert csv.local_csv(spark, f"file://{tmp_path}/a.csv").dtypes == [("x", "int"), ("y", "string")]
    (tmp_path / "b.csv").write_text("1,a\n")
    assert csv.named(csv.remote_csv(spark, f"file://{tmp_path}/b.csv", header=False), "n", "s").first().asDict() == {"n": 1, "s": "a"}
    for fn, data in ((plots.plot_scatter, [[(1, 2), (3, 4)]]), (plots.plot_xy_lines, [[(1, 2), (3, 4)], []])):
        fn(data, plots.PlotSetting(title="T<", captions=["one"]), str(tmp_path / "p.html"))
        assert "T&lt;" in (tmp_path / "p.html").read_text()
    plots.plot_lines([[1.0, 2.0]], None, plots.PlotSetting(), str(tmp_path / "q.html"))
    assert plots.human_readable_camel("areaUnderROC") == "Area Under ROC" and plots.non_alphanumeric_to_underscore("a b-c") == "a_b_c"
