"""Connected components of an undirected graph by local contraction and alternating star contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, functions as F

from ..storage import remove, written

#: Edges that are contracted at a time.
CHUNK = 2_000_000


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the graph with edges a-b: each node that isn't the smallest of its component, and that smallest."""
    nodes, flat = np.unique(np.concatenate((a, b)), return_inverse=True)
    i, j = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[i], label[j])
        before = label.copy()
        for x in (i, j, before[i], before[j]):
            np.minimum.at(label, x, low)
        while not np.array_equal(label, label[label]):
            label = label[label]
        if np.array_equal(label, before):
            break
    other = label != np.arange(len(nodes))
    return nodes[other], nodes[label[other]]


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's edges as a spanning forest of stars, some edges at a time."""
    held, n = [], 0

    def out():
        u, v = roots(np.concatenate([u for u, _ in held]), np.concatenate([v for _, v in held]))
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    for b in batches:
        held.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
        n += b.num_rows
        if n >= CHUNK:
            yield out()
            held, n = [], 0
    if held:
        yield out()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component) for every node with an edge; the component is its smallest node.

    First edges are dealt out and each task contracts its own to stars around their smallest nodes. Then each round points larger
    neighbours at the smallest one (large star), and does the same for the smaller ones (small star); the number of
    rounds grows with the logarithm of the graph, and a graph that isn't done after `rounds` raises an error. Minima are
    combined before the shuffle and joined back, so a node with very many edges is split by the adaptive skew join, and
    each round is cut in shared storage. Self-loops and repeated edges are ignored; null ends are dropped.
    """
    spark = edges.sparkSession
    u, v = F.col(a).cast("long"), F.col(b).cast("long")
    now = edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u <> v AND u IS NOT NULL AND v IS NOT NULL")
    now = now.distinct().mapInArrow(_contracted, "u long, v long")  # behind a shuffle, so that no task runs two Python workers
    last = path = None
    for _ in range(rounds):
        seen, before = Observation(), path
        now, path = written(now.observe(seen, F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")), "edges")
        if before:
            remove(spark, before)
        mark = (seen.get.get("n"), seen.get.get("x"))  # taken while writing: whether the round changed anything
        if mark == last or not mark[0]:
            break
        last = mark
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            low.where("m < u").select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v")
        now = small.distinct()
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    # stars now: each node but the smallest has one edge, to the smallest
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
