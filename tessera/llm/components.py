"""Connected components of a graph by alternating large-star and small-star rounds (Kiveris et al., 2014).

Minima are aggregated with map-side partial sums and joined back, so that a node with a third of all edges collects
nothing in one task; every round is written to the shared folder, so that a lost executor costs no more than a round.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stored


def _directed(edges: DataFrame) -> DataFrame:
    """Distinct edges from the larger to the smaller end, without loops."""
    return edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> (node, root) of every node with an edge to another; root is the smallest node reachable."""
    now, before = stored(_directed(edges), "edges"), None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))")).first()
        if mark == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = mark
        now = stored(_directed(_small_star(_directed(_large_star(now)))), "edges")


def nearest_forest(a: np.ndarray, b: np.ndarray, distance: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Which of the edges (a, b) make a minimum spanning forest over groups of points; ``group`` numbers each point's.

    Edges are taken level by level of their distance, so that points that a threshold connects are connected by edges
    below it.
    """
    parent, chosen = np.arange(int(group.max(initial=-1)) + 1), [np.zeros(0, np.int64)]
    order = np.argsort(distance, kind="stable")
    for level in np.split(order, np.flatnonzero(np.diff(distance[order])) + 1):
        while len(level):
            p, q = parent[group[a[level]]], parent[group[b[level]]]
            apart = p != q
            level, p, q = level[apart], p[apart], q[apart]
            joined, first = np.unique(np.maximum(p, q), return_index=True)
            chosen.append(level[first])
            parent[joined] = np.minimum(p, q)[first]
            while not np.array_equal(parent, up := parent[parent]):
                parent = up
    return np.concatenate(chosen)
