"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trussline.llm.common import drop_stored, stored


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of ``n`` nodes over the edges (a[i], b[i])."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for side in (a, b):
            np.minimum.at(new, side, low)
            np.minimum.at(new, label[side], low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    while True:
        new = label[label]
        if np.array_equal(new, label):
            return label
        label = new


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
    low = edges.groupBy("hi").agg(F.min("lo").alias("m"))
    ends = both.filter("lo > hi").select(F.col("hi").alias("node"), F.col("lo").alias("big"))
    joined = ends.join(low.withColumnRenamed("hi", "node"), "node", "left")
    return joined.select(F.col("big").alias("hi"), F.coalesce("m", "node").alias("lo")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("hi").agg(F.min("lo").alias("m"))
    joined = edges.join(low, "hi")
    moved = joined.filter("lo > m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return moved.union(low.select("hi", F.col("m").alias("lo"))).distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Smallest node of the component of each node that has an edge.

    Edges with a null end and self edges are ignored; repeated edges count once; an empty table gives an empty table.
    Columns other than ``a`` and ``b`` are ignored. Returns (node long, component long). Each round is a constant
    number of shuffles and ends in a written table; rounds grow with the logarithm of the longest chain.
    """
    pair = edges.select(F.col(a).cast("long").alias("x"), F.col(b).cast("long").alias("y"))
    now = stored(pair.filter("x <> y").select(F.greatest("x", "y").alias("hi"), F.least("x", "y").alias("lo")).distinct(), "edges")
    for _ in range(max_rounds):
        after = stored(_small_star(_large_star(now)), "edges")
        drop_stored(now)
        now = after
        marks = now.select(F.col("hi").alias("node"), F.lit(1).alias("is_hi"), F.lit(0).alias("is_lo")).union(now.select("lo", F.lit(0), F.lit(1)))
        # done when every edge goes from a node to its root: one edge each, and no root has an edge of its own
        open_nodes = marks.groupBy("node").agg(F.sum("is_hi").alias("n"), F.max("is_lo").alias("root")).filter("n > 1 or (n = 1 and root = 1)")
        if open_nodes.isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(now.select("lo", "lo").distinct())
