"""Connected components of a graph that is kept in tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def components(edges: DataFrame, keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """v, root for every node with an edge (a, b) to another: the smallest node of its component.

    Edges point from the larger node v to the smaller w.  A round hooks each v under the
    smallest neighbour of its w (large star), then v and all its w's under the smallest of
    these (small star).  Both keep what is connected; rounds go on until only stars are
    left, about the square of the logarithm of the nodes at most.  ``keep`` stores a table
    under a name and reads it back.
    """
    links = edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("w")).distinct()
    links, k = keep(links, "0"), 0
    while True:
        low = links.groupBy("v").agg(F.min("w").alias("m"), F.count(F.lit(1)).alias("n"))
        deep = links.select(F.col("w").alias("v")).join(low, "v", "left_semi")
        if low.where("n > 1").select("v").unionByName(deep).isEmpty():
            break
        large = links.join(low.select(F.col("v").alias("w"), "m"), "w", "left").select("v", F.coalesce("m", "w").alias("w"))
        least = large.groupBy("v").agg(F.min("w").alias("m"))
        under = large.join(least, "v").where("w <> m").select(F.col("w").alias("v"), F.col("m").alias("w"))
        k += 1
        links = keep(under.unionByName(least.select("v", F.col("m").alias("w"))).distinct(), str(k))
    roots = links.select(F.col("w").alias("v"), F.col("w").alias("root")).distinct()
    return links.select("v", F.col("w").alias("root")).unionByName(roots)
