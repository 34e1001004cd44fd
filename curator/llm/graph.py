"""Connected components of an edge table, as joins and aggregates on it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, kept, scratch_scope, written


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each node of these edges, other than the least of its component: the node and that least one."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while (up := parent.get(x, x)) != top:
            parent[x] = top
            x = up
        return top

    for x, y in zip(a.tolist(), b.tolist()):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    nodes = list(parent)
    return np.array(nodes, np.int64), np.array([root(x) for x in nodes], np.int64)


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's edges as stars: at most one edge for each node of a batch."""
    for batch in batches:
        a, b = spanning(batch.column(0).to_numpy(), batch.column(1).to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def _with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """edges with m, the value that least (a, m) has for their a.

    least is a table of its own first, so that the join is planned with its size: a small one is broadcast, and for a
    large one both sides are dealt by a, of which Spark splits what a node with many edges makes too large.
    """
    return edges.join(written(least), "a")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return _with_least(both.where("b > a"), least).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = written(down.groupBy("a").agg(F.min("b").alias("m")))
    across = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return across.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether the edges, which all lead to lesser nodes, are stars: every node has one edge down or is a centre."""
    leaves = edges.select("a", F.lit(1).alias("n"), F.lit(0).alias("top"))
    tops = edges.select(F.col("b").alias("a"), F.lit(0).alias("n"), F.lit(1).alias("top")).distinct()
    return leaves.unionByName(tops).groupBy("a").agg(F.sum("n").alias("n"), F.max("top").alias("top")).where("n > 1 OR (n = 1 AND top = 1)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node with an edge; the component is its least node.

    Alternates large and small stars until only stars are left, which takes a number of rounds that grows with the
    logarithm of the size. Every round is a table in the shared folder. Self-loops and nulls are left out.
    """
    now = written(edges.toDF("a", "b").where("a <> b").mapInArrow(_local, "a bigint, b bigint").distinct())
    while not _settled(now):
        with scratch_scope():
            after = kept(_small_star(written(_large_star(now))))
        dropped(now)
        now = after
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
