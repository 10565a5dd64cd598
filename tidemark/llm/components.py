"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

#: Edges of a task, so that few edges don't make many small files.
EDGES_A_TASK = 200_000
#: Nodes of more than this share of all edges (so fewer than twice as many) are joined by broadcast, as no task should hold all their edges.
HOT_SHARE = 1000


def _star(edges: DataFrame, count: int, large: bool) -> DataFrame:
    """One step on edges (u, v): every neighbour that is larger (not larger) is tied to the least one."""
    turned = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    near = edges.union(turned) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = near.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("held")).withColumn("m", F.least("u", "m"))
    many = max(EDGES_A_TASK, count // HOT_SHARE)
    if 2 * count <= many:  # no node has so many edges
        tied = near.join(least.select("u", "m"), "u")
    else:
        hot = F.broadcast(least.where(F.col("held") > many).select("u", "m"))
        tied = near.join(hot, "u").unionByName(near.join(hot, "u", "left_anti").join(least.select("u", "m"), "u"))
    if large:
        out = tied.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u != v").coalesce(_tasks(count)).distinct().coalesce(_tasks(count))


def _tasks(count: int) -> int:
    return 1 + count // EDGES_A_TASK


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node that each node of the edges (u, v) can reach.

    Each round ties neighbours to the least one seen, until a round changes nothing; the number of
    rounds grows with the logarithm of the longest path. The driver sees two numbers a round.
    Nodes are longs; null ends and loops are dropped, so an unlinked node has no row.
    """
    edges = checkpoint(edges.select("u", "v").where("u != v").distinct())
    count, seen = edges.count(), None
    while True:
        edges = edges.coalesce(_tasks(count))
        edges = checkpoint(_star(_star(edges, count, large=True), count, large=False))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        count, seen = now[0], now
    edges = edges.coalesce(_tasks(count))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())


def spanning(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[list[int], list[int]]:
    """Places (i, j) of links that join different components ``left``[i], ``right``[j]; no more of them than a forest has edges."""
    names, local = np.unique(np.concatenate((left, right)), return_inverse=True)
    mine, other = local[: len(left)], local[len(left) :]
    i, j = np.nonzero(linked & (mine[:, None] != other[None]))
    _, first = np.unique(mine[i] * len(names) + other[j], return_index=True)
    root, out = list(range(len(names))), ([], [])

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for k in first.tolist():
        x, y = find(mine[i[k]]), find(other[j[k]])
        if x != y:
            root[x] = y
            out[0].append(int(i[k]))
            out[1].append(int(j[k]))
    return out
