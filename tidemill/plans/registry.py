"""Queries over the shared tables and the SQL each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Pipeline
from pyspark.ml.feature import StringIndexerModel, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions import vectors
from tidemill.operators import learners as L
from tidemill.operators import metrics as M
from tidemill.operators.prep import BooleanLabelIndexer, FixedOrderStringIndexer, IndexToStringIfNeeded, IndexVectorizer, VectorHead, index_strings, join_by_order, prepare_features
from tidemill.operators.reservoir import Network, ReservoirSpec, ReservoirStates, reservoir
from tidemill.operators.results import ClassificationSetting, RegressionSetting, ServiceSetting, TemporalSetting
from tidemill.operators.sampling import Sampling, forward_chain_splits, seq_split, split_by_value
from tidemill.operators.scaling import ColumnNormNormalizer, in_place_pca, numeric_scaler, transformed, vector_scaler
from tidemill.operators.service import LearningService
from tidemill.operators.stages import Cacher, DropSeriesLeft, FilterGroupsWithCount
from tidemill.operators.windows import SeqShift, SlidingWindow, order_dependent_predictions, top_orders
from tidemill.sources.csv import named, parquet

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def add(name: str, run: Query, sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql is not None:
        ORACLE_SQL[name] = sql


def table(s: SparkSession, d: str, name: str) -> DataFrame:
    return parquet(s, f"{d}/{name}.parquet")


def _half_away(x: Column, digits: int) -> Column:
    """As the SQL rounds doubles: the scaled number to the next whole one, halves away from zero; the sign of a zero stays."""
    scaled = F.abs(x) * F.lit(10.0**digits)
    whole = F.rint(scaled)
    whole = F.when(scaled - whole == 0.5, whole + 1.0).otherwise(whole) / F.lit(10.0**digits)
    result = F.when((x < 0) | (x.cast("string") == "-0.0"), -whole).otherwise(whole)
    return F.when(F.isnan(result) | (F.abs(result) == float("inf")), x).otherwise(result)


def rounded(c: str | Column, digits: int = 6) -> Column:
    return _half_away((F.col(c) if isinstance(c, str) else c).cast("double"), digits)


def rounded_array(c: Column, digits: int = 6) -> Column:
    return F.transform(c, lambda x: _half_away(x, digits))


def events(s: SparkSession, d: str) -> DataFrame:
    """idx (order), user_id (group), value, event_type."""
    return table(s, d, "events").select(F.col("event_id").cast("int").alias("idx"), "user_id", "value", "event_type")


def event_vectors(s: SparkSession, d: str) -> DataFrame:
    e = events(s, d).select("idx", "user_id", "value", (F.col("idx") % 7).cast("double").alias("k"))
    return e.withColumn("v", array_to_vector(F.array("value", "k")))


def gapped(s: SparkSession, d: str) -> DataFrame:
    return events(s, d).select("idx", "user_id", "value").where("idx % 10 <> 0")


def item_vectors(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return VectorAssembler(inputCols=["l_quantity", "l_extendedprice", "l_discount", "l_tax"], outputCol="features").transform(t)


EV = "(SELECT CAST(event_id AS INTEGER) AS idx, user_id, value, event_type, CAST(event_id % 7 AS DOUBLE) AS k FROM events)"
GAPPED = f"(SELECT idx, user_id, value FROM {EV} WHERE idx % 10 <> 0)"

# --- windows and shifts -------------------------------------------------------------------------------------------

add(
    "sliding_window",
    lambda s, d: SlidingWindow(inputCol="value", outputCol="w", orderCol="idx", windowSize=3).transform(events(s, d)).select("idx", "w"),
    f"SELECT * FROM (SELECT idx, list(value) OVER (ORDER BY idx ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS w FROM {EV}) WHERE len(w) = 3",
)
add(
    "sliding_window_grouped",
    lambda s, d: SlidingWindow(inputCol="v", outputCol="w", orderCol="idx", groupCol="user_id", windowSize=3).transform(event_vectors(s, d)).select("idx", "user_id", vector_to_array("w").alias("w")),
    f"SELECT idx, user_id, flatten(l) AS w FROM (SELECT idx, user_id, list([value, k]) OVER (PARTITION BY user_id ORDER BY idx ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS l FROM {EV}) WHERE len(l) = 3",
)
WINDOW_JOIN = f"SELECT a.idx, [c.value, b.value, a.value] AS w FROM {GAPPED} a JOIN {GAPPED} b ON b.idx = a.idx - 1 JOIN {GAPPED} c ON c.idx = a.idx - 2"
add(
    "sliding_window_consecutive",
    lambda s, d: SlidingWindow(inputCol="value", outputCol="w", orderCol="idx", windowSize=3, consecutive=True).transform(gapped(s, d)).select("idx", vector_to_array("w").alias("w")),
    WINDOW_JOIN,
)
add(
    "sliding_window_consecutive_joins",
    lambda s, d: SlidingWindow(inputCol="value", outputCol="w", orderCol="idx", windowSize=3, consecutive=True, duplicates=True).transform(gapped(s, d)).select("idx", vector_to_array("w").alias("w")),
    WINDOW_JOIN,
)
add(
    "seq_shift",
    lambda s, d: SeqShift(inputCol="value", outputCol="next", orderCol="idx", shift=5).transform(events(s, d)).select("idx", "next"),
    f"SELECT a.idx, a.next FROM (SELECT idx, lead(value, 5) OVER (ORDER BY idx) AS next, row_number() OVER (ORDER BY idx DESC) AS r FROM {EV}) a WHERE r > 5",
)
add(
    "seq_shift_grouped_strict",
    lambda s, d: SeqShift(inputCol="value", outputCol="next", orderCol="idx", groupCol="user_id", shift=2).transform(events(s, d)).select("idx", "user_id", "next"),
    f"SELECT idx, user_id, next FROM (SELECT idx, user_id, lead(value, 2) OVER (PARTITION BY user_id ORDER BY idx) AS next, row_number() OVER (PARTITION BY user_id ORDER BY idx DESC) AS r FROM {EV}) WHERE r > 2",
)
add(
    "seq_shift_grouped_compat",
    lambda s, d: SeqShift(inputCol="value", outputCol="next", orderCol="idx", groupCol="user_id", shift=2, mode="compat").transform(events(s, d)).select("idx", "user_id", "next"),
    f"SELECT idx, user_id, next FROM (SELECT idx, user_id, last_value(value) OVER (PARTITION BY user_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS next FROM {EV}) WHERE idx < (SELECT min(idx) FROM (SELECT DISTINCT idx FROM {EV} ORDER BY idx DESC LIMIT 2))",
)
add(
    "seq_shift_consecutive",
    lambda s, d: SeqShift(inputCol="value", outputCol="next", orderCol="idx", shift=2, consecutive=True).transform(gapped(s, d)).select("idx", "next"),
    f"SELECT a.idx, b.value AS next FROM {GAPPED} a JOIN {GAPPED} b ON b.idx = a.idx + 2",
)
add(
    "order_dependent_predictions",
    lambda s, d: _window_predictions(s, d),
    f"SELECT * FROM (SELECT idx, list(value) OVER (ORDER BY idx ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS w FROM {EV}) WHERE len(w) = 4 AND idx > 500",
)


def _window_predictions(s: SparkSession, d: str) -> DataFrame:
    full = events(s, d).select("idx", "value")
    model = Pipeline(stages=[SlidingWindow(inputCol="value", outputCol="w", orderCol="idx", windowSize=4)]).fit(full)
    return order_dependent_predictions(model, full, split_by_value(full, "idx", 500)[1], "idx").select("idx", "w")


# --- filters, splits, samples -------------------------------------------------------------------------------------

add(
    "drop_nulls",
    lambda s, d: events(s, d).select("idx", F.nullif(F.col("event_type"), F.lit("click")).alias("kind"), F.when(F.col("idx") % 3 != 0, F.col("value")).alias("value")).na.drop(),
    f"SELECT idx, event_type AS kind, value FROM {EV} WHERE event_type <> 'click' AND idx % 3 <> 0",
)
add(
    "drop_series_left",
    lambda s, d: DropSeriesLeft(orderCol="idx", count=50).transform(events(s, d)).select("idx", "value"),
    f"SELECT idx, value FROM {EV} WHERE idx > (SELECT min(idx) FROM {EV}) + 50",
)
add(
    "filter_groups_with_count",
    lambda s, d: FilterGroupsWithCount(groupCol="user_id", expectedCount=62).transform(events(s, d)).select("idx", "user_id"),
    f"SELECT idx, user_id FROM {EV} WHERE user_id IN (SELECT user_id FROM events GROUP BY user_id HAVING count(*) = 62)",
)


def _parts(parts: dict[str, DataFrame], *columns: str) -> DataFrame:
    out = None
    for name, df in parts.items():
        df = df.select(F.lit(name).alias("part"), *columns)
        out = df if out is None else out.unionByName(df)
    return out


add(
    "seq_split_ratio",
    lambda s, d: _parts(dict(zip(("head", "tail"), seq_split(events(s, d), "idx", 0.8, 0.0), strict=True)), "idx"),
    f"SELECT CASE WHEN idx <= (SELECT quantile_disc(idx, 0.8) FROM {EV}) THEN 'head' ELSE 'tail' END AS part, idx FROM {EV}",
)
add(
    "seq_split_value",
    lambda s, d: _parts(dict(zip(("head", "tail"), split_by_value(events(s, d), "idx", 777), strict=True)), "idx"),
    f"SELECT CASE WHEN idx <= 777 THEN 'head' ELSE 'tail' END AS part, idx FROM {EV}",
)
add(
    "forward_chain_folds",
    lambda s, d: _parts({f"{k}{r}": f for k, fs in enumerate(forward_chain_splits(events(s, d), "idx", 3, 0.4, 0.0)) for r, f in zip("tvb", fs, strict=True)}, "idx"),
    f"""WITH e AS {EV}, b AS (SELECT quantile_disc(idx, 0.4) AS b0, quantile_disc(idx, 0.6) AS b1, quantile_disc(idx, 0.8) AS b2, max(idx) AS b3 FROM e)
SELECT part, idx FROM (
SELECT '0t' AS part, idx FROM e, b WHERE idx <= b0 UNION ALL SELECT '0v', idx FROM e, b WHERE idx > b0 AND idx <= b1 UNION ALL SELECT '0b', idx FROM e, b WHERE idx <= b1 UNION ALL
SELECT '1t', idx FROM e, b WHERE idx <= b1 UNION ALL SELECT '1v', idx FROM e, b WHERE idx > b1 AND idx <= b2 UNION ALL SELECT '1b', idx FROM e, b WHERE idx <= b2 UNION ALL
SELECT '2t', idx FROM e, b WHERE idx <= b2 UNION ALL SELECT '2v', idx FROM e, b WHERE idx > b2 AND idx <= b3 UNION ALL SELECT '2b', idx FROM e, b WHERE idx <= b3)""",
)
add(
    "sample_by_label_all_none",
    lambda s, d: Sampling.of([("F", 0.0), ("O", 1.0)]).transform(table(s, d, "orders").withColumn("labelString", F.col("o_orderstatus"))).select("o_orderkey", "labelString"),
    "SELECT o_orderkey, o_orderstatus AS \"labelString\" FROM orders WHERE o_orderstatus <> 'F'",
)
add(
    "union_resampled",
    lambda s, d: table(s, d, "orders").where("o_orderstatus = 'P'").union(table(s, d, "orders").where("o_orderstatus <> 'P'")).select("o_orderkey", "o_totalprice"),
    "SELECT o_orderkey, o_totalprice FROM orders",
)
add("top_k_orders", lambda s, d: top_orders(events(s, d), "idx", 10), f"SELECT idx FROM {EV} ORDER BY idx DESC LIMIT 10")
add("distinct_orders", lambda s, d: events(s, d).select("user_id").distinct(), "SELECT DISTINCT user_id FROM events")
add(
    "scalar_aggregates",
    lambda s, d: events(s, d).agg(F.count("*").alias("n"), F.min("idx").alias("lo"), F.max("idx").alias("hi")),
    f"SELECT count(*) AS n, min(idx) AS lo, max(idx) AS hi FROM {EV}",
)
add(
    "sample_by_label_half",
    lambda s, d: Sampling.of([("F", 0.5)], 7).transform(table(s, d, "orders").withColumn("labelString", F.col("o_orderstatus"))).select("o_orderkey", "labelString"),
)

# --- preparation --------------------------------------------------------------------------------------------------

add(
    "string_index_freq",
    lambda s, d: index_strings(table(s, d, "orders").select("o_orderkey", "o_orderpriority"), [("o_orderpriority", None)]),
    "SELECT o_orderkey, CAST(r AS DOUBLE) AS o_orderpriority FROM orders JOIN (SELECT o_orderpriority, row_number() OVER (ORDER BY count(*) DESC, o_orderpriority) - 1 AS r FROM orders GROUP BY o_orderpriority) USING (o_orderpriority)",
)
add(
    "string_index_fixed",
    lambda s, d: FixedOrderStringIndexer(inputCol="r_name", outputCol="i", labels=["EUROPE", "ASIA", "AFRICA", "AMERICA", "MIDDLE EAST"], handleInvalid="keep").fit(table(s, d, "region")).transform(table(s, d, "region")).select("r_regionkey", "i"),
    "SELECT r_regionkey, CASE r_name WHEN 'EUROPE' THEN 0.0::DOUBLE WHEN 'ASIA' THEN 1 WHEN 'AFRICA' THEN 2 WHEN 'AMERICA' THEN 3 WHEN 'MIDDLE EAST' THEN 4 ELSE 5 END AS i FROM region",
)
add(
    "boolean_label",
    lambda s, d: BooleanLabelIndexer(stringLabelCol="text").transform(table(s, d, "labels").select("doc_id", (F.col("toxic") == 1).alias("label"))).select("doc_id", "label", "text"),
    "SELECT doc_id, CAST(toxic AS DOUBLE) AS label, CASE WHEN toxic = 1 THEN 'true' ELSE 'false' END AS text FROM labels",
)


def _index_to_string(s: SparkSession, d: str) -> DataFrame:
    t = StringIndexerModel.from_labels(["F", "O", "P"], inputCol="o_orderstatus", outputCol="i").transform(table(s, d, "orders").select("o_orderkey", "o_orderstatus"))
    return IndexToStringIfNeeded(inputCol="i", outputCol="back").transform(t).select("o_orderkey", "back")


add("index_to_string", _index_to_string, "SELECT o_orderkey, o_orderstatus AS back FROM orders")
add(
    "one_hot",
    lambda s, d: IndexVectorizer(inputCol="c_nationkey", outputCol="h").transform(table(s, d, "customer").select("c_custkey", "c_nationkey")).select("c_custkey", vector_to_array("h").alias("h")),
    "SELECT c_custkey, list_transform(range(0, (SELECT max(c_nationkey) + 1 FROM customer)), lambda i: CASE WHEN i = c_nationkey THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS h FROM customer",
)
add(
    "prep_features",
    lambda s, d: prepare_features(table(s, d, "part").select("p_partkey", "p_size", "p_retailprice"), {"p_retailprice", "p_size", "nothing"}, "p_size").select("p_partkey", vector_to_array("features").alias("features"), "label"),
    "SELECT p_partkey, [CAST(p_size AS DOUBLE), p_retailprice] AS features, p_size AS label FROM part",
)
add(
    "vector_head",
    lambda s, d: VectorHead(inputCol="v", outputCol="h").transform(event_vectors(s, d)).select("idx", "h"),
    f"SELECT idx, value AS h FROM {EV}",
)
add(
    "vector_concat",
    lambda s, d: event_vectors(s, d).select("idx", vector_to_array(vectors.concat_vectors("v", "v")).alias("c")),
    f"SELECT idx, [value, k, value, k] AS c FROM {EV}",
)
add(
    "vector_map",
    lambda s, d: event_vectors(s, d).select("idx", vector_to_array(vectors.map_vector_indexed("v", lambda x, i: x * 2 + i)).alias("m")),
    f"SELECT idx, [value * 2, k * 2 + 1] AS m FROM {EV}",
)
add(
    "vector_argmax",
    lambda s, d: event_vectors(s, d).select("idx", vectors.argmax(vector_to_array("v")).alias("a")),
    f"SELECT idx, CASE WHEN k > value THEN 1 ELSE 0 END AS a FROM {EV}",
)
add(
    "vector_transpose",
    lambda s, d: vectors.transpose_vectors(event_vectors(s, d), ["v"], "idx").select("pos", "v"),
    f"SELECT 0 AS pos, list(value ORDER BY idx) AS v FROM {EV} UNION ALL SELECT 1, list(k ORDER BY idx) FROM {EV}",
)
add(
    "join_by_order",
    lambda s, d: join_by_order(events(s, d).select("idx", "value"), table(s, d, "orders").select("o_orderkey"), "idx", "o_orderkey").select("idx", "o_orderkey"),
    f"SELECT idx, o_orderkey FROM (SELECT idx, row_number() OVER (ORDER BY idx) AS r FROM {EV}) JOIN (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS r FROM orders) USING (r)",
)
add("positional_rename", lambda s, d: named(table(s, d, "region"), "key", "name"), "SELECT r_regionkey AS key, r_name AS name FROM region")
add("cacher", lambda s, d: Cacher().transform(table(s, d, "nation")), "SELECT * FROM nation")

# --- scalers, norms, vector aggregates ----------------------------------------------------------------------------

NAMES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def _scaled(kind: str) -> Query:
    return lambda s, d: transformed(vector_scaler(kind, "features", "x"), item_vectors(s, d)).select("l_orderkey", "l_linenumber", rounded_array(vector_to_array("x")).alias("x"))


def _normed(p: float) -> Query:
    return lambda s, d: transformed(ColumnNormNormalizer(inputCol="features", outputCol="x", p=p), item_vectors(s, d)).select("l_orderkey", "l_linenumber", rounded_array(vector_to_array("x")).alias("x"))


def _scaled_sql(each: str, stats: str) -> str:
    stat = ", ".join(stats.format(c=c) for c in NAMES)
    return f"SELECT l_orderkey, l_linenumber, [{', '.join(f'round({each.format(c=c)}, 6)' for c in NAMES)}] AS x FROM lineitem, (SELECT {stat} FROM lineitem)"


add("scale_l1", _scaled("L1Normalizer"), _scaled_sql("{c} / {c}_n", "sum(abs({c})) AS {c}_n"))
add("scale_l2", _scaled("L2Normalizer"), _scaled_sql("{c} / {c}_n", "sqrt(sum({c} * {c})) AS {c}_n"))
add("scale_pnorm3", _normed(3.0), _scaled_sql("{c} / {c}_n", "pow(sum(pow(abs({c}), 3)), 1.0 / 3) AS {c}_n"))
add("scale_linf", _normed(float("inf")), _scaled_sql("{c} / {c}_n", "max(abs({c})) AS {c}_n"))
add("scale_standard", _scaled("StandardScaler"), _scaled_sql("({c} - {c}_m) / {c}_s", "avg({c}) AS {c}_m, stddev_samp({c}) AS {c}_s"))
add("scale_minmax01", _scaled("MinMaxZeroOneScaler"), _scaled_sql("({c} - {c}_a) / ({c}_b - {c}_a)", "min({c}) AS {c}_a, max({c}) AS {c}_b"))
add("scale_minmax11", _scaled("MinMaxPlusMinusOneScaler"), _scaled_sql("({c} - {c}_a) / ({c}_b - {c}_a) * 2 - 1", "min({c}) AS {c}_a, max({c}) AS {c}_b"))
add("scale_maxabs", _scaled("MaxAbsScaler"), _scaled_sql("{c} / {c}_n", "max(abs({c})) AS {c}_n"))
add(
    "scale_label",
    lambda s, d: transformed(numeric_scaler("StandardScaler", "value", "x"), events(s, d)).select("idx", rounded("x").alias("x")),
    f"SELECT idx, round((value - m) / s, 6) AS x FROM {EV}, (SELECT avg(value) AS m, stddev_samp(value) AS s FROM events)",
)
for _name, _fn in (("vector_sum", vectors.vector_sum), ("vector_min", vectors.vector_min), ("vector_max", vectors.vector_max)):
    _agg = _name[7:]
    add(
        _name,
        lambda s, d, fn=_fn: fn(event_vectors(s, d), "v", ["user_id"]).select("user_id", rounded_array(F.col("v")).alias("v")),
        f"SELECT user_id, [round({_agg}(value), 6), round({_agg}(k), 6)] AS v FROM {EV} GROUP BY user_id",
    )
for _name, _fn, _one in (("running_min", vectors.running_min, "least(value, k)"), ("running_max", vectors.running_max, "greatest(value, k)"), ("running_sum", vectors.running_sum, "value + k")):
    add(
        _name,
        lambda s, d, fn=_fn: (lambda e: e.select("idx", "user_id", rounded(fn(e, "v", "idx", "user_id"), 4).alias("r")))(event_vectors(s, d)),
        f"SELECT idx, user_id, round({_name[8:]}({_one}) OVER (PARTITION BY user_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 4) AS r FROM {EV}",
    )
add(
    "column_norms",
    lambda s, d: _parts({str(p): vectors.column_norms(item_vectors(s, d), "features", p).select(rounded_array(F.col("features"), 3).alias("n")) for p in (1, 2, 3)}, "n"),
    " UNION ALL ".join(f"SELECT '{p}' AS part, [{', '.join(f'round(pow(sum(pow(abs({c}), {p})), 1.0 / {p}), 3)' for c in NAMES)}] AS n FROM lineitem" for p in (1, 2, 3)),
)
add(
    "metric_stats",
    lambda s, d: M.metric_stats(events(s, d).select(F.col("event_type").alias("metric"), F.lit(0).alias("repetition"), F.when(F.col("idx") % 3 == 0, "test").otherwise("training").alias("split"), "value")).select("metric", "split", *[rounded(c).alias(c) for c in ("mean", "min", "max", "variance", "median")]),
    f"SELECT event_type AS metric, CASE WHEN idx % 3 = 0 THEN 'test' ELSE 'training' END AS split, round(avg(value), 6) AS mean, round(min(value), 6) AS min, round(max(value), 6) AS max, round(coalesce(var_samp(value), 0), 6) AS variance, round(median(value), 6) AS median FROM {EV} GROUP BY 1, 2",
)

# --- metrics and curves -------------------------------------------------------------------------------------------


def _judged(s: SparkSession, d: str) -> DataFrame:
    return events(s, d).select((F.col("idx") % 4).cast("double").alias("label"), F.when(F.col("idx") % 5 < 3, F.col("idx") % 4).otherwise(F.col("idx") % 3).cast("double").alias("prediction"))


def _scored(s: SparkSession, d: str) -> DataFrame:
    return events(s, d).select(F.round(F.col("value") + F.col("idx") % 3 * 20, 0).alias("score"), F.when(F.col("idx") % 3 == 2, 1.0).otherwise(F.when(F.col("idx") % 11 == 0, 1.0).otherwise(0.0)).alias("label"))


CM = f"""WITH e AS (SELECT idx % 4 AS label, CASE WHEN idx % 5 < 3 THEN idx % 4 ELSE idx % 3 END AS prediction FROM {EV}),
a AS (SELECT label AS c, count(*) AS n, count(*) FILTER (label = prediction) AS tp FROM e GROUP BY 1), b AS (SELECT prediction AS c, count(*) AS m FROM e GROUP BY 1),
j AS (SELECT a.c, n, tp, CASE WHEN coalesce(m, 0) > 0 THEN tp / m ELSE 0.0 END AS p, tp / n AS r FROM a LEFT JOIN b USING (c))"""
CUM = f"""WITH e AS (SELECT round(value + idx % 3 * 20, 0) AS score, CASE WHEN idx % 3 = 2 OR idx % 11 = 0 THEN 1.0 ELSE 0.0 END AS label FROM {EV}),
g AS (SELECT score, sum(label) AS h, sum(1 - label) AS m FROM e GROUP BY score),
c AS (SELECT score, sum(h) OVER w AS tp, sum(m) OVER w AS fp, (SELECT sum(h) FROM g) AS p, (SELECT sum(m) FROM g) AS n FROM g WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING))"""
add(
    "confusion_metrics",
    lambda s, d: M.multiclass_metrics(_judged(s, d)).select(*[rounded(c).alias(c) for c in M.CLASSIFICATION]),
    f"{CM} SELECT round(sum(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END * n) / sum(n), 6) AS f1, round(sum(p * n) / sum(n), 6) AS \"weightedPrecision\", round(sum(r * n) / sum(n), 6) AS \"weightedRecall\", round(sum(tp) / sum(n), 6) AS accuracy FROM j",
)
add(
    "regression_metrics",
    lambda s, d: M.regression_metrics(events(s, d).select(F.col("value").alias("label"), (F.col("value") * 0.9 + F.col("idx") % 5).alias("prediction"))).select(*[rounded(c).alias(c) for c in M.REGRESSION]),
    f"SELECT round(avg(x * x), 6) AS mse, round(sqrt(avg(x * x)), 6) AS rmse, round(1 - sum(x * x) / (var_pop(value) * count(*)), 6) AS r2, round(avg(abs(x)), 6) AS mae FROM (SELECT value, value - (value * 0.9 + idx % 5) AS x FROM {EV})",
)
add(
    "roc_curve",
    lambda s, d: M.roc_curve(_scored(s, d)).select(rounded("x").alias("x"), rounded("y").alias("y")),
    f"{CUM} SELECT round(fp / n, 6) AS x, round(tp / p, 6) AS y FROM c UNION ALL SELECT 0.0, 0.0 UNION ALL SELECT 1.0, 1.0",
)
add(
    "pr_curve",
    lambda s, d: M.pr_curve(_scored(s, d)).select(rounded("x").alias("x"), rounded("y").alias("y")),
    f"{CUM} SELECT round(tp / p, 6) AS x, round(tp / (tp + fp), 6) AS y FROM c UNION ALL SELECT 0.0, (SELECT round(tp / (tp + fp), 6) FROM c ORDER BY score DESC LIMIT 1)",
)
add(
    "threshold_curves",
    lambda s, d: M.threshold_curves(_scored(s, d)).select("threshold", *[rounded(c).alias(c) for c in ("precision", "recall", "f1")]),
    f"{CUM} SELECT score AS threshold, round(q, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN q + r > 0 THEN 2 * q * r / (q + r) ELSE 0.0 END, 6) AS f1 FROM (SELECT score, tp / (tp + fp) AS q, tp / p AS r FROM c)",
)
add(
    "auc",
    lambda s, d: M.areas(_scored(s, d)).select(*[rounded(c).alias(c) for c in M.BINARY]),
    f"""{CUM}, t AS (SELECT score, fp / n AS x, tp / p AS y, tp / (tp + fp) AS q FROM c)
SELECT round(sum((x - x0) * (y + y0) / 2), 6) AS "areaUnderROC", round(sum((y - y0) * (q + q0) / 2), 6) AS "areaUnderPR"
FROM (SELECT x, y, q, coalesce(lag(x) OVER w, 0) AS x0, coalesce(lag(y) OVER w, 0) AS y0, coalesce(lag(q) OVER w, q) AS q0 FROM t WINDOW w AS (ORDER BY score DESC))""",
)
add(
    "one_hot_prediction",
    lambda s, d: M.one_hot_prediction(events(s, d).select("idx", F.lit(0.0).alias("prediction"))).select("idx", vector_to_array("probability").alias("probability")),
    f"SELECT idx, [1.0::DOUBLE, 0.0::DOUBLE] AS probability FROM {EV}",
)

# --- learners -----------------------------------------------------------------------------------------------------


def _line(s: SparkSession, d: str) -> DataFrame:
    return prepare_features(table(s, d, "part").select(F.col("p_size").cast("double").alias("p_size"), "p_retailprice"), {"p_size"}, "p_retailprice")


def _coefficients(spec: L.Regressor) -> Query:
    def run(s: SparkSession, d: str) -> DataFrame:
        m = L.build_estimator(spec)[0].fit(_line(s, d))
        return s.createDataFrame([(float(m.coefficients[0]), float(m.intercept))], "slope double, intercept double").select(rounded("slope").alias("slope"), rounded("intercept").alias("intercept"))

    return run


LINE_SQL = "SELECT round(regr_slope(p_retailprice, p_size), 6) AS slope, round(regr_intercept(p_retailprice, p_size), 6) AS intercept FROM part"
add("ols_fit", _coefficients(L.LinearRegression(solver="normal", regularization=0.0)), LINE_SQL)
add("glm_gaussian_fit", _coefficients(L.GeneralizedLinearRegression(family="gaussian", link="identity", regularization=0.0)), LINE_SQL)


def _naive_bayes_fit(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "lineitem").select(F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0).alias("label"), array_to_vector(F.array("l_quantity", F.col("l_linenumber").cast("double"))).alias("features"))
    m = L.build_estimator(L.NaiveBayes(smoothing=1.0, model_type="multinomial"))[0].fit(t)
    rows = [(float(c), float(m.pi[c]), *[float(x) for x in m.theta.toArray()[c]]) for c in range(2)]
    return s.createDataFrame(rows, "label double, pi double, a double, b double").select("label", *[rounded(c).alias(c) for c in ("pi", "a", "b")])


add(
    "naive_bayes_fit",
    _naive_bayes_fit,
    """WITH e AS (SELECT CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS label, l_quantity AS x, l_linenumber AS y FROM lineitem), g AS (SELECT label, count(*) AS n, sum(x) AS x, sum(y) AS y FROM e GROUP BY label)
SELECT label, round(ln(n + 1.0) - ln((SELECT sum(n) FROM g) + 2.0), 6) AS pi, round(ln(x + 1) - ln(x + y + 2), 6) AS a, round(ln(y + 1) - ln(x + y + 2), 6) AS b FROM g""",
)


def _embedded(s: SparkSession, d: str, classes: int) -> DataFrame:
    t = table(s, d, "embeddings").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"), (F.col("label") % classes).cast("string").alias("label"))
    return index_strings(t, [("label", [str(k) for k in range(classes)])])


def _priced(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "lineitem").select("l_quantity", "l_discount", "l_tax", (F.col("l_extendedprice") / 1000).alias("price"))
    return prepare_features(t, {"l_quantity", "l_discount", "l_tax"}, "price")


def _positive(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "lineitem").select("l_quantity", "l_discount", "l_tax", "l_returnflag")
    return prepare_features(index_strings(t, [("l_returnflag", None)]), {"l_quantity", "l_discount", "l_tax"}, "l_returnflag")


SERVICE = LearningService(ServiceSetting(seed=11))
SMALL = L.TreeCore(max_depth=3, seed=1)
CLASSIFIERS: dict[str, tuple[L.Classifier, int]] = {
    "logistic_regression": (L.LogisticRegression(max_iteration=20), 3),
    "multi_layer_perceptron": (L.MultiLayerPerceptron(hidden_layers=(8,), max_iteration=20, seed=1), 3),
    "decision_tree": (L.DecisionTree(core=SMALL), 3),
    "random_forest": (L.RandomForest(num_trees=5, core=SMALL), 3),
    "gradient_boost_tree": (L.GradientBoostTree(max_iteration=3, core=SMALL), 2),
    "linear_svm": (L.LinearSupportVectorMachine(max_iteration=10), 2),
}
REGRESSORS: dict[str, L.Regressor] = {
    "linear_regression": L.LinearRegression(regularization=0.01),
    "generalized_linear_regression": L.GeneralizedLinearRegression(family="gaussian", link="identity"),
    "regression_tree": L.RegressionTree(core=SMALL),
    "random_regression_forest": L.RandomRegressionForest(num_trees=5, core=SMALL),
    "gradient_boost_regression_tree": L.GradientBoostRegressionTree(max_iteration=3, core=SMALL),
}
CLUSTERERS: dict[str, L.Clusterer] = {
    "kmeans": L.KMeans(k=4, max_iteration=10, seed=1),
    "bisecting_kmeans": L.BisectingKMeans(k=4, max_iteration=5, seed=1),
    "gaussian_mixture": L.GaussianMixture(k=3, max_iteration=5, seed=1),
    "lda": L.LDA(k=3, max_iteration=5, seed=1),
}
for _name, (_spec, _classes) in CLASSIFIERS.items():
    add(f"classify_{_name}", lambda s, d, spec=_spec, n=_classes: SERVICE.classify(_embedded(s, d, n), spec, ClassificationSetting(features_normalization="StandardScaler", pca_dims=8)).frame(s))
add("classify_naive_bayes", lambda s, d: SERVICE.classify(_positive(s, d), L.NaiveBayes()).frame(s))
for _name, _spec in REGRESSORS.items():
    add(f"regress_{_name}", lambda s, d, spec=_spec: SERVICE.regress(_priced(s, d), spec, RegressionSetting(repetitions=1)).frame(s))
for _name, _spec in CLUSTERERS.items():
    add(f"cluster_{_name}", lambda s, d, spec=_spec: SERVICE.cluster(_priced(s, d), spec, "MinMaxZeroOneScaler").select("label", "cluster"))
add("pca", lambda s, d: transformed(in_place_pca(3), _embedded(s, d, 3)).select("vec_id", vector_to_array("features").alias("p")))
add(
    "pca_plane",
    lambda s, d: transformed(in_place_pca(1, "v"), event_vectors(s, d)).select("idx", rounded(F.abs(vector_to_array("v")[0])).alias("p")),
    f"""WITH m AS (SELECT var_samp(value) AS a, var_samp(k) AS b, covar_samp(value, k) AS c FROM {EV}), e AS (SELECT c, (a + b) / 2 + sqrt(pow((a - b) / 2, 2) + c * c) - a AS d FROM m)
SELECT idx, round(abs(value * c + k * d) / sqrt(c * c + d * d), 6) AS p FROM {EV}, e""",
)


def _steps(s: SparkSession, d: str) -> DataFrame:
    """k (0 to 6) as the only feature; the label, 1 from 4 up, is a step that every learner must find."""
    e = event_vectors(s, d).select("idx", array_to_vector(F.array("k")).alias("features"), F.when(F.col("k") > 3, "yes").otherwise("no").alias("label"))
    return index_strings(e, [("label", ["no", "yes"])])


STEP_SQL = f"SELECT idx, CASE WHEN k > 3 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS prediction FROM {EV}"
for _name, (_spec, _) in CLASSIFIERS.items():
    if _name != "multi_layer_perceptron":
        add(f"step_{_name}", lambda s, d, spec=_spec: transformed(L.build_estimator(spec)[0], _steps(s, d)).select("idx", "prediction"), STEP_SQL)
add("step_multi_layer_perceptron", lambda s, d: transformed(L.build_estimator(L.MultiLayerPerceptron(hidden_layers=(3,), max_iteration=200, seed=1), 1, 2)[0], _steps(s, d)).select("idx", "prediction"), STEP_SQL)
for _name in ("regression_tree", "random_regression_forest", "gradient_boost_regression_tree"):
    add(f"step_{_name}", lambda s, d, spec=REGRESSORS[_name]: transformed(L.build_estimator(spec)[0], _steps(s, d)).select("idx", rounded("prediction").alias("prediction")), STEP_SQL)


def _clouds(spec: L.Clusterer) -> Query:
    """Three clouds far apart; a cluster is named by its smallest row."""

    def run(s: SparkSession, d: str) -> DataFrame:
        e = events(s, d).select("idx", array_to_vector(F.array(F.col("value") / 100 + F.col("idx") % 3 * 1000, F.col("value") % 7 - F.col("idx") % 3 * 500)).alias("features"))
        found = SERVICE.cluster(e, spec).select("idx", "cluster")
        return found.join(found.groupBy("cluster").agg(F.min("idx").alias("first")), "cluster").select("idx", "first")

    return run


for _name, _spec in (("kmeans", L.KMeans(k=3, seed=1)), ("bisecting_kmeans", L.BisectingKMeans(k=3, seed=1)), ("gaussian_mixture", L.GaussianMixture(k=3, max_iteration=20, seed=1))):
    add(f"clouds_{_name}", _clouds(_spec), f"SELECT idx, CAST(idx % 3 AS INTEGER) AS first FROM {EV}")
add("kfold_cv", lambda s, d: SERVICE.regress(_priced(s, d), L.LinearRegression(regularization=L.Grid(0.0, 0.1)), RegressionSetting(folds=3)).frame(s))

# --- series -------------------------------------------------------------------------------------------------------


def _series(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").select(F.col("event_id").cast("int").alias("index"), "value", (F.col("event_id") % 24).cast("double").alias("hour"))
    return prepare_features(e, {"value", "hour"}, "value").select("index", "features", "label")


def _flags(s: SparkSession, d: str) -> DataFrame:
    e = _series(s, d).withColumn("label", F.col("label") > 50)
    return BooleanLabelIndexer().transform(e)


NETWORK = ReservoirSpec(nodes=12, in_degree=4, spectral_radius=0.9, weights=("normal", 0.0, 1.0), washout=20)


def _reservoir_by_user(s: SparkSession, d: str) -> DataFrame:
    stage = ReservoirStates(inputCol="v", outputCol="x", orderCol="idx", groupCol="user_id", spec=ReservoirStates.spec_json(PAIR), seed=5)
    scaled = event_vectors(s, d).select("idx", "user_id", array_to_vector(F.array(F.col("value") / 100, F.col("k") / 7)).alias("v"))
    return stage.transform(scaled).select("idx", "user_id", rounded_array(vector_to_array("x")).alias("x"))


def _reservoir_sql() -> str:
    """The recurrence in SQL, with the network's own numbers."""
    net = Network(PAIR, 2, 5)
    step = lambda i, old: f"tanh({' + '.join([f'({w!r}) * {u}' for w, u in zip(net.w_in[i].tolist(), ('a', 'b'), strict=True)] + [f'({w!r}) * {o}' for w, o in zip(net.w[i].tolist(), old, strict=True)])} + ({float(net.w_bias[i])!r}))"
    start = [repr(float(x)) for x in net.initial]
    return f"""WITH RECURSIVE e AS (SELECT idx, user_id, value / 100 AS a, k / 7 AS b, row_number() OVER (PARTITION BY user_id ORDER BY idx) AS r FROM {EV}),
s AS (SELECT idx, user_id, r, {step(0, start)} AS x0, {step(1, start)} AS x1 FROM e WHERE r = 1
UNION ALL SELECT e.idx, e.user_id, e.r, {step(0, ("x0", "x1"))}, {step(1, ("x0", "x1"))} FROM s JOIN e ON e.user_id = s.user_id AND e.r = s.r + 1)
SELECT idx, user_id, [round(x0, 6), round(x1, 6)] AS x FROM s"""


PAIR = ReservoirSpec(nodes=2, spectral_radius=0.8, weights=("normal", 0.0, 1.0), reservoir_bias=True)
add("reservoir_states_grouped", _reservoir_by_user, _reservoir_sql())
add("reservoir_states", lambda s, d: reservoir("features", "index", "states", NETWORK).fit(_series(s, d)).transform(_series(s, d)).select("index", vector_to_array("states").alias("states")))
add("regress_ts", lambda s, d: SERVICE.regress_time_series(_series(s, d), L.LinearRegression(), TemporalSetting(core=RegressionSetting(split_ratio=0.8), sliding_window=4)).frame(s))
add("classify_ts", lambda s, d: SERVICE.classify_time_series(_flags(s, d), L.LogisticRegression(max_iteration=10), TemporalSetting(core=ClassificationSetting(split_ratio=0.8), reservoir=NETWORK)).frame(s))
add("forward_cv", lambda s, d: SERVICE.regress_time_series(_series(s, d), L.LinearRegression(), TemporalSetting(core=RegressionSetting(split_ratio=0.8, folds=2), sliding_window=L.Grid(2, 4))).frame(s))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of three values by user, the value one step ahead as label, least squares, and its metrics as rows."""
    e = events(spark, sf_dir).withColumn("label", F.col("value")).withColumn("features", array_to_vector(F.array("value")))
    setting = TemporalSetting(core=RegressionSetting(split_ratio=0.8), sliding_window=3, order_col="idx", group_col="user_id")
    return SERVICE.regress_time_series(e, L.LinearRegression(solver="normal"), setting).frame(spark)


add("flagship", flagship)
