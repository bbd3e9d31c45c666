"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourloom.llm.common import settled

#: Edges that a task of a round has, about; a few edges are not dealt out to many tasks.
TASK_EDGES = 50_000


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """__node and __root (the smallest node it is linked to, itself included) of every node with an edge.

    Large star: all larger neighbours of a node move to its smallest neighbour; small star: all
    smaller ones do. Both are a grouped minimum, combined before the shuffle, and an equi-join that
    adaptive execution may split at nodes with very many edges. The rounds, about the logarithm of
    the longest path, end when the edges no longer change; the state is a checkpoint per round.
    """
    down = (F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    now = settled(edges.filter(F.col(a) != F.col(b)).select(*down).distinct())
    mark = None
    while True:
        new = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()  # exact
        if not new[0] or tuple(new) == mark:
            return now.select(F.col("u").alias("__node"), F.col("v").alias("__root")).union(
                now.select("v", "v").distinct())
        mark, tasks = tuple(new), max(4, -(-new[0] // TASK_EDGES))
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least.coalesce(tasks), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = settled(large.coalesce(tasks).distinct().coalesce(tasks))
        small = large.groupBy("u").agg(F.min("v").alias("m")).coalesce(tasks)
        moved = large.join(small, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = settled(moved.union(small.select("u", F.col("m").alias("v"))).coalesce(tasks).distinct().coalesce(tasks))


class Forest:
    """Components of the few thousand things that one task compares."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def link(self, i: int, others: np.ndarray) -> None:
        own = self.label[others]
        roots = np.unique(np.append(own, self.label[i]))
        if len(roots) > 1:
            self.label[np.isin(self.label, roots[1:])] = roots[0]
