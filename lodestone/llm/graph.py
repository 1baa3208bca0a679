"""Connected components of a graph too large for one machine."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, durable

#: Edges that a task unites in memory.
EDGES = 1 << 19


def united(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges that aren't the least of their component, and that least node for each."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    i, j, root = at[: len(u)], at[len(u) :], np.arange(len(nodes))
    while True:
        a, b = root[i], root[j]
        apart = a != b
        if not apart.any():
            low = root != np.arange(len(nodes))
            return nodes[low], nodes[root[low]]
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))  # a root hooks to the least root next to it
        while (root[root] != root).any():
            root = root[root]


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's edges as stars, of at most about EDGES edges held at once; they connect what the edges connect."""
    u = v = np.zeros(0, np.int64)
    for b in batches:
        u, v = (np.concatenate([x, b.column(k).to_numpy(zero_copy_only=False)]) for x, k in ((u, "u"), (v, "v")))
        if len(u) >= EDGES:
            u, v = united(u, v)
            if 2 * len(u) > EDGES:
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])
                u = v = np.zeros(0, np.int64)
    u, v = united(u, v)
    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link the neighbours of each node (those above it, or those below and itself) to the least of them."""
    ways = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = ways.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    met = ways.join(least, "u")
    if large:
        return met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
    return met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def components(edges: DataFrame, tag: str) -> DataFrame:
    """(node, root) of each node of ``edges`` (u, v: long); root is the least node of its component.

    Each task first turns EDGES edges at a time into stars, without a shuffle, which is all the work if there are no more.
    What stays too many for one task after that alternates large and small stars, each a sum by node and a join that Spark can split,
    until nothing changes; each round ends in a table.  Null ends are left out.
    """

    def then(df: DataFrame) -> DataFrame:
        out = durable(df, tag)
        drop(now)
        return out

    stars = lambda df: df.mapInArrow(_forest, "u long, v long")
    now = durable(stars(edges.where("u IS NOT NULL AND v IS NOT NULL AND u != v").select("u", "v")), tag)
    mark = lambda df: tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
    n = now.count()
    while n:
        tasks = -(-n // EDGES)
        if tasks == 1:
            now = then(stars(now.coalesce(1)))
            break
        now = then(stars(now.coalesce(tasks)).distinct())
        before = mark(now)
        if 2 * before[0] > n:
            now = then(_star(_star(now, True), False))
            after = mark(now)
            if after == before:
                break
            before = after
        n = before[0]
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
