"""Connected components of a link table, by alternating large-star and small-star steps on DataFrames.

Each step moves links towards the smallest node of their neighbourhood and is written to the shared folder; both sides
of every join are written tables, so adaptive execution can split the partition of a hot node. Nothing but two numbers
a round reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm import scratch


def _digest(links: DataFrame) -> tuple[int, int]:
    r = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").bitwiseAND(F.lit(0xFFFFFFFF))).alias("h")).first()
    return r["n"], r["h"] or 0


def connected_components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``links`` (u long, v long); the component is its smallest node.

    Links may repeat, point either way or join a node to itself; rows with a null end are ignored. No links: no rows.
    """
    links = scratch.materialize(links.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u IS NOT NULL AND v IS NOT NULL"), "given")
    alone = links.where("u = v").select("u").distinct()
    now = scratch.materialize(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    loops = scratch.materialize(alone, "loops")
    before = _digest(now)
    for _ in range(rounds):
        if not before[0]:
            break
        # Large star: every larger neighbour of u links to the smallest of u's neighbourhood.
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch.materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = scratch.materialize(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        scratch.discard(now, least)
        # Small star: u and its smaller neighbours link to the smallest of them.
        least = scratch.materialize(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        pairs = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = scratch.materialize(pairs.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        scratch.discard(large, least)
        after = _digest(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select(F.col("v").alias("node")).distinct()
    members = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    single = roots.unionByName(loops.select(F.col("u").alias("node"))).select("node", F.col("node").alias("component"))
    return members.unionByName(single).groupBy("node").agg(F.min("component").alias("component"))


def spanning(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (smallest node of its component, node) that join what the links u-v join."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        for side in (a, b):
            np.minimum.at(new, label[side], least)
            np.minimum.at(new, side, least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    other = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[label[other]], nodes[other]


def spanning_links(found: Iterator[tuple[np.ndarray, np.ndarray]], most: int = 500_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A task's links as spanning forests: whatever number of groups tells of the same neighbours, a node leaves about once. At most about twice ``most`` links are held."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for u, v in found:
        if len(u):
            held.append((u, v))
            size += len(u)
        if size > most:
            held = [spanning(*(np.concatenate(x) for x in zip(*held, strict=True)))]
            size = len(held[0][0])
            if 2 * size > most:
                yield held.pop()
                size = 0
    if held:
        yield spanning(*(np.concatenate(x) for x in zip(*held, strict=True)))
