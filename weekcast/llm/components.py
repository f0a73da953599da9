"""Connected components of links between numbered things, without hubs in one task and without the driver.

Tasks that find links reduce them to a spanning forest first (``Forest``). The forests are joined by alternating
large-star and small-star steps, each an aggregation and a plain join over tables in the shared folder, until
every node points at the smallest one of its component.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekcast.llm.common import materialize


class Forest:
    """Components of positions 0 to n - 1 inside one task, for links that come in arrays."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            a, b = self.root[i], self.root[j]
            apart = a != b
            if not apart.any():
                return
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = self.root[self.root]
                if np.array_equal(up, self.root):
                    break
                self.root = up


def _state(edges: DataFrame):
    digest = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    return tuple(edges.agg(F.count(F.lit(1)), digest).first())


def connected(links: DataFrame, left: str, right: str) -> DataFrame:
    """(id, component): for every node that has a link, the smallest node reachable from it."""
    edges = links.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v"))
    edges = materialize(edges.where("u <> v").distinct(), "links")
    state = _state(edges)
    while True:
        # Large star: every larger neighbour of a node is linked to the smallest node around it.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.where("u <> v").distinct(), "links")
        # Small star: a node and its smaller neighbours are linked to the smallest of them.
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialize(small.unionByName(least.withColumnRenamed("m", "v")).distinct(), "links")
        before, state = state, _state(edges)
        if state == before:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
