"""Connected components of an edge table, by contraction in rounds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.session import stage


class Forest:
    """Union-find over 0..n-1 whose roots are the smallest members."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        """Join a[k] with b[k]: hooks roots on smaller roots until nothing changes."""
        p = self.parent
        while True:
            x, y = p[a], p[b]
            low, high = np.minimum(x, y), np.maximum(x, y)
            if (low == high).all():
                return
            np.minimum.at(p, high, low)
            while True:
                up = p[p]
                if (up == p).all():
                    break
                p[:] = up

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """Each member that is no root, and its root."""
        low = np.flatnonzero(self.parent != np.arange(len(self.parent)))
        return low, self.parent[low]


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); component is the smallest node.

    Each round hangs every node on the smallest of its neighbours and itself and then
    follows these pointers, so that trees shrink by more than half; the result is reached
    when only stars remain.  Rounds are written to the shared folder.  A node's minimum is a
    partial aggregate, so that a hub's neighbours never meet in one place.
    """
    links = stage(
        edges.where(F.col("a") != F.col("b"))
        .select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).distinct(),
        "links",
    )
    star = links
    while True:
        # large star: neighbours above a node go to its smallest neighbour
        both = star.select(F.col("low").alias("x"), F.col("high").alias("y")).union(star.select("high", "low"))
        least = both.groupBy("x").agg(F.min("y").alias("m")).withColumn("m", F.least("x", "m"))
        large = (
            both.join(least, "x").where(F.col("y") > F.col("x"))
            .select(F.col("m").alias("low"), F.col("y").alias("high")).distinct()
        )
        # small star: neighbours below a node, and itself, go to the smallest of them
        large = stage(large, "large")
        least = large.groupBy("high").agg(F.min("low").alias("m"))
        hung = large.join(least, "high")
        small = stage(
            hung.where(F.col("low") != F.col("m")).select(F.col("m").alias("low"), F.col("low").alias("high"))
            .union(least.select(F.col("m").alias("low"), "high")).distinct(),
            "small",
        )
        # finished when every node has one link and no smaller node is itself linked below
        open_ = small.select(F.col("high").alias("k")).groupBy("k").count().where("count > 1").limit(1).count()
        deep = small.select("low").join(small.select(F.col("high").alias("low")).distinct(), "low", "left_semi").limit(1).count()
        star = small
        if not open_ and not deep:
            break
    return star.select(F.col("high").alias("node"), F.col("low").alias("component")).union(
        star.select("low", "low").distinct()
    )
