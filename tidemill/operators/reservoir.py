"""Echo-state reservoirs: a fixed random recurrent network driven by a series, its states the features.

x(t) = f(W_in u(t) + w_bias + W x(t-1)), W rescaled to a spectral radius (Jaeger 2001; Lukosevicius and Jaeger 2009).
Weights are a function of the spec and the seed, so every copy of a stage has the same network, and each pass starts
from the initial state.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Pipeline
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import TypeConverters
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.errors import TidemillError
from tidemill.functions import vectors
from tidemill.operators.stages import RenameInPlace, Stage, need, need_not, param
from tidemill.operators.windows import piece_of, range_bounds
from tidemill.session import ship_package

FUNCTIONS = {
    "Tanh": np.tanh,
    "Sigmoid": lambda x: 1 / (1 + np.exp(-x)),
    "Linear": lambda x: x,
    "Relu": lambda x: np.maximum(x, 0),
    "Sin": np.sin,
    "HardLimit": lambda x: (x > 0).astype(float),
    "SymHardLimit": lambda x: np.where(x > 0, 1.0, -1.0),
    "Gaussian": lambda x: np.exp(-x * x),
}
#: The functions that one line of plain Python states for every number, as the C library has them.
PLAIN = {"Tanh": "tanh({})", "Linear": "{}", "HardLimit": "1.0 if {} > 0 else 0.0", "SymHardLimit": "1.0 if {} > 0 else -1.0"}
PLAIN_EDGES = 256


@dataclass(frozen=True)
class ReservoirSpec:
    """``weights``: ("normal", mean, sd) or ("uniform", low, high). Numbers that are None are left open: in-degree and edges mean a full matrix, connectivity that every input reaches every node."""

    input_nodes: int | None = None
    bias: float = 1.0
    non_bias_initial: float = 0.0
    nodes: Any = 10
    in_degree: Any = None
    in_degree_distribution: tuple | None = None
    edges: Any = None
    preferential_attachment: bool = False
    reservoir_bias: bool = False
    circular_in_edges: tuple[int, ...] | None = None
    allow_self_edges: bool = True
    allow_multi_edges: bool = False
    input_connectivity: Any = None
    weights: tuple = ("normal", 0.0, 1.0)
    spectral_radius: Any = None
    function: str = "Tanh"
    function_params: tuple[float, ...] = ()
    per_node_functions: tuple[str, ...] | None = None
    washout: Any = None


class Network:
    """A reservoir's matrices and its step."""

    def __init__(self, spec: ReservoirSpec, inputs: int, seed: int):
        rng = np.random.default_rng(seed)
        n = int(spec.nodes)
        draw = lambda size: rng.normal(spec.weights[1], spec.weights[2], size) if spec.weights[0] == "normal" else rng.uniform(spec.weights[1], spec.weights[2], size)
        w = np.zeros((n, n))
        for to, source in self._edges(spec, n, rng):
            w[to, source] += float(draw(1)[0])
        radius = float(np.abs(np.linalg.eigvals(w)).max()) if n else 0.0
        if spec.spectral_radius is not None and radius > 0:
            w *= float(spec.spectral_radius) / radius
        connected = rng.random((n, inputs)) < (1.0 if spec.input_connectivity is None else float(spec.input_connectivity))
        self.w, self.w_in = w, draw((n, inputs)) * connected
        self.w_bias = draw(n) * spec.bias if spec.reservoir_bias else np.zeros(n)
        self.initial = np.full(n, float(spec.non_bias_initial))
        names = spec.per_node_functions or (spec.function,) * n
        if len(names) != n or any(f not in FUNCTIONS for f in names):
            raise TidemillError("each node needs one of the functions " + ", ".join(FUNCTIONS))
        self.names = names
        self.functions = [(FUNCTIONS[f], np.array([k for k, x in enumerate(names) if x == f])) for f in dict.fromkeys(names)]
        self._plain: tuple | None = None

    @staticmethod
    def _edges(spec: ReservoirSpec, n: int, rng: np.random.Generator) -> Iterator[tuple[int, int]]:
        if spec.circular_in_edges is not None:
            yield from ((to, (to - back) % n) for to in range(n) for back in spec.circular_in_edges)
            return
        allowed = lambda to: [s for s in range(n) if spec.allow_self_edges or s != to]
        if spec.edges is not None:
            pairs = [(to, s) for to in range(n) for s in allowed(to)]
            pick = rng.choice(len(pairs), int(spec.edges) if spec.allow_multi_edges else min(int(spec.edges), len(pairs)), replace=spec.allow_multi_edges)
            yield from (pairs[k] for k in pick)
            return
        out = np.ones(n)
        for to in range(n):
            sources = allowed(to)
            if spec.in_degree_distribution is not None:
                kind, a, b = spec.in_degree_distribution
                degree = round(float(rng.normal(a, b) if kind == "normal" else rng.uniform(a, b)))
            else:
                degree = len(sources) if spec.in_degree is None else int(spec.in_degree)
            degree = max(0, degree if spec.allow_multi_edges else min(degree, len(sources)))
            p = out[sources] / out[sources].sum() if spec.preferential_attachment and sources else None
            for s in rng.choice(sources, degree, replace=spec.allow_multi_edges, p=p) if sources and degree else ():
                out[int(s)] += 1
                yield to, int(s)

    def states(self, inputs: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
        """The state after each row, from the initial one or the one ``before``. Sums go over the inputs, then the nodes, then the bias."""
        x, n = self.initial if before is None else before, len(self.initial)
        driven = np.zeros((len(inputs), n))
        for k in range(self.w_in.shape[1]):
            driven = inputs[:, k : k + 1] * self.w_in[:, k] + (driven if k else 0.0)
        if self._plain is None or self._plain[0] is not self.w or self._plain[1] is not self.w_bias:
            self._plain = self.w, self.w_bias, self._plain_step()
        step = self._plain[2]
        if step is not None:
            return np.array(step(driven.tolist(), x.tolist()), float).reshape(len(inputs), n)
        out = np.empty((len(inputs), n))
        for t in range(len(inputs)):
            y = driven[t] + self.w @ x + self.w_bias
            x = np.empty_like(y)
            for f, at in self.functions:
                x[at] = f(y[at])
            out[t] = x
        return out

    def _plain_step(self) -> Callable | None:
        """The recurrence as a function of its own, numbers written out, where the network is small: numpy's calls would cost more than its sums."""
        edges = [[k for k in range(len(self.initial)) if row[k]] for row in self.w]
        if not 0 < len(edges) <= PLAIN_EDGES or sum(map(len, edges)) > PLAIN_EDGES or any(f not in PLAIN for f in self.names) or not (np.isfinite(self.w).all() and np.isfinite(self.w_bias).all()):
            return None
        sums = [" + ".join([f"d{i}", *(f"({float(self.w[i, k])!r}) * x{k}" for k in at), *([f"({float(self.w_bias[i])!r})"] if self.w_bias[i] else [])]) for i, at in enumerate(edges)]
        new = ", ".join(PLAIN[f].format(f"({y})") for f, y in zip(self.names, sums, strict=True))
        d, x = (", ".join(f"{c}{i}" for i in range(len(edges))) + "," for c in "dx")
        body = f"def step(driven, state):\n    {x} = state\n    out = []\n    put = out.extend\n    for {d} in driven:\n        {x} = {new},\n        put(({x}))\n    return out\n"
        scope: dict = {"tanh": math.tanh}
        exec(body, scope)  # noqa: S102
        return scope["step"]


class ReservoirStates(Stage):
    """The reservoir's states after each row of a series, rows of equal order sharing the state after the last of them.

    Without ``groupCol`` a series is cut into pieces by its order, and each task has rows of its pieces only, sorted,
    of which one batch is in Python at a time. The states in which the pieces start are found first: all pieces run at
    once from the ends of those before them as known so far, until no end changes a start. A reservoir that forgets needs two
    rounds, any other at most one for each piece; the states are those of one run through the series to the last bit.
    Rows with a null order drop. ``washout``: rows drop whose order exceeds the smallest by no more than it.
    """

    inputCol = param("inputCol", "vector column that drives the network", TypeConverters.toString)
    outputCol = param("outputCol", "vector of states; may be the input", TypeConverters.toString)
    orderCol = param("orderCol", "order column", TypeConverters.toString)
    groupCol = param("groupCol", "column that separates series", TypeConverters.toString)
    spec = param("spec", "reservoir spec as JSON", TypeConverters.toString)
    seed = param("seed", "seed of the weights", TypeConverters.toInt)
    nodes = param("nodes", "overrides the spec's", TypeConverters.toInt)
    spectralRadius = param("spectralRadius", "overrides the spec's", TypeConverters.toFloat)
    inDegree = param("inDegree", "overrides the spec's", TypeConverters.toInt)
    edges = param("edges", "overrides the spec's", TypeConverters.toInt)
    inputConnectivity = param("inputConnectivity", "overrides the spec's", TypeConverters.toFloat)
    washout = param("washout", "how far from the smallest order rows are dropped", TypeConverters.toInt)
    defaults = {"seed": 42}

    @staticmethod
    def spec_json(spec: ReservoirSpec) -> str:
        return json.dumps(asdict(spec))

    def _spec(self) -> ReservoirSpec:
        values = {k: tuple(v) if isinstance(v, list) else v for k, v in json.loads(self.required("spec")).items()}
        own = {"nodes": "nodes", "spectralRadius": "spectral_radius", "inDegree": "in_degree", "edges": "edges", "inputConnectivity": "input_connectivity"}
        return ReservoirSpec(**values | {v: self.value(k) for k, v in own.items() if self.value(k) is not None})

    def _transform(self, df: DataFrame) -> DataFrame:
        source, target, order, group = self.required("inputCol"), self.required("outputCol"), self.required("orderCol"), self.value("groupCol")
        need(df.schema, source, order, *([group] if group else []))
        if source != target:
            need_not(df.schema, target)
        ship_package(df.sparkSession)
        spec, seed = self._spec(), self.value("seed")

        slim = df.withColumn("_u", vectors.as_array(df, source)).drop(*([source] if source == target else []))
        carried = [c for c in slim.columns if c != "_u"]
        place = F.struct(*[F.col(c) for c in carried])

        starts: dict[int, np.ndarray] = {}  # of the pieces of one series; a group starts from the initial state

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Rows come by group and order. Only the state and the rows of the last order are kept from batch to batch."""
            net, state, last = None, None, None
            held: list[pa.RecordBatch] = []  # rows of the last order so far: rows to come may share and change their state

            def placed(rows: list[pa.RecordBatch], states: np.ndarray) -> pa.RecordBatch:
                row = pa.Table.from_batches(rows)["_row"].combine_chunks()
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(states) + 1, dtype=np.int32) * states.shape[1]), pa.array(states.ravel()))
                return pa.RecordBatch.from_arrays([row, lists], names=["_row", "_x"])

            for batch in batches:
                if not len(batch):
                    continue
                group_at, order_at, u = batch.column(0), batch.column(1), inputs_of(batch.column(2))
                if net is None:
                    net = Network(spec, u.shape[1], seed)
                begin = changes(group_at)
                fresh = begin | changes(order_at)
                if held and (group_at[0].as_py(), order_at[0].as_py()) != last:
                    yield placed(held, np.tile(state, (sum(map(len, held)), 1)))
                    held = []
                parts, groups = [], [0, *np.flatnonzero(begin).tolist(), len(batch)]
                for a, b in zip(groups, groups[1:]):
                    g = group_at[a].as_py()
                    if last is None or g != last[0]:
                        state = net.initial if group else starts.get(g, net.initial)
                    parts.append(net.states(u[a:b], state))
                    state, last = parts[-1][-1], (g, order_at[b - 1].as_py())
                states = np.concatenate(parts)
                new = np.array([0, *np.flatnonzero(fresh).tolist()])
                shared = states[np.repeat(np.append(new[1:], len(batch)) - 1, np.diff(np.append(new, len(batch))))]
                rows, end = batch.select(["_row"]), int(new[-1])
                if end:
                    before = sum(map(len, held))
                    yield placed([*held, rows.slice(0, end)], np.concatenate([np.tile(shared[0], (before, 1)), shared[:end]]))
                    held = []
                held.append(rows.slice(end))
            if held:
                yield placed(held, np.tile(state, (sum(map(len, held)), 1)))

        slim = slim.where(F.col(order).isNotNull())
        bounds = [] if group else range_bounds(df.select(order), order)
        key = F.col(group) if group else piece_of(order, bounds)
        sort = lambda d: d.repartition("_g").sortWithinPartitions("_g", "_o")
        if bounds:
            starts |= _starts(slim.select(key.alias("_g"), F.col(order).alias("_o"), "_u"), sort, len(bounds) + 1, spec, seed)
        dealt = sort(slim.select(key.alias("_g"), F.col(order).alias("_o"), "_u", place.alias("_row")))
        kind = T.StructType([T.StructField("_row", dealt.schema["_row"].dataType), T.StructField("_x", T.ArrayType(T.DoubleType()))])
        out = dealt.mapInArrow(run, kind)
        if self.value("washout") is not None:
            least = df.agg(F.min(order).alias("_least"))  # one row, found without the states
            out = out.join(F.broadcast(least), F.col("_row")[order] > F.col("_least") + self.value("washout"))
        return out.select(*[F.col("_row")[c].alias(c, metadata=slim.schema[c].metadata) for c in carried], array_to_vector("_x").alias(target))


def inputs_of(column: pa.Array) -> np.ndarray:
    """Rows by inputs from lists of one length; a null in a list is no number."""
    if column.null_count:
        raise TidemillError("the input of a reservoir is null")
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def changes(column: pa.Array) -> np.ndarray:
    """Whether each value differs from the one before; the first does not."""
    a, b = column.slice(1), column.slice(0, len(column) - 1)
    differ = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b)))
    return np.concatenate([[False], differ.to_numpy(zero_copy_only=False).astype(bool)])


def _starts(rows: DataFrame, sort: Callable, pieces: int, spec: ReservoirSpec, seed: int) -> dict[int, np.ndarray]:
    """The state before each piece of (_g: piece, _o: order, _u: inputs). Starts and ends of pieces, a state each, are all that comes to the driver."""
    starts: dict[int, np.ndarray] = {}
    ends: dict[int, np.ndarray] = {}
    todo = list(range(pieces))
    while todo:

        def run(batches: Iterator[pa.RecordBatch], starts=dict(starts)) -> Iterator[pa.RecordBatch]:
            net, state, last = None, None, None
            give = lambda: pa.RecordBatch.from_arrays([pa.array([last], pa.int32()), pa.array([state.tolist()], pa.list_(pa.float64()))], names=["_g", "_x"])
            for batch in batches:
                if not len(batch):
                    continue
                keys, u = batch.column(0).to_numpy(), inputs_of(batch.column(2))
                if net is None:
                    net = Network(spec, u.shape[1], seed)
                cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
                for a, b in zip(cuts, cuts[1:]):
                    if keys[a] != last:
                        if last is not None:
                            yield give()
                        last, state = int(keys[a]), starts.get(int(keys[a]), net.initial)
                    state = net.states(u[a:b], state)[-1]
            if last is not None:
                yield give()

        part = rows if len(todo) == pieces else rows.where(F.col("_g").isin(todo))
        ends |= {r["_g"]: np.array(r["_x"]) for r in sort(part).mapInArrow(run, "_g int, _x array<double>").collect()}
        todo, before = [], None
        for k in range(pieces):  # a piece without rows hands on what came before it
            if before is not None and not (k in starts and np.array_equal(starts[k], before, equal_nan=True)):
                starts[k] = before
                todo.append(k)
            before = ends.get(k, before)
    return starts


def reservoir(source: str, order: str, target: str, spec: ReservoirSpec, group: str | None = None, seed: int = 42) -> Pipeline:
    """States and, if the spec has a washout, without the first of them."""
    return Pipeline(stages=[ReservoirStates(inputCol=source, outputCol=target, orderCol=order, groupCol=group, spec=ReservoirStates.spec_json(spec), seed=seed, washout=spec.washout)])


def reservoir_in_place(column: str, order: str, spec: ReservoirSpec, seed: int = 42) -> Pipeline:
    temp = f"{column}_tmp"
    return Pipeline(stages=[reservoir(column, order, temp, spec, seed=seed), RenameInPlace(source=temp, target=column)])
