"""Connected components by alternating star contraction over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import materialise


def components(edges: DataFrame, name: str = "graph") -> DataFrame:
    """``edges(u, v)`` to ``(node, root)``, the root being the least id of the component.

    Each round takes the edges of every node towards larger ones to its least neighbour, then
    those towards smaller ones; rounds end when the edges no longer change.  Loops and nulls are
    dropped.  Only a count and a checksum reach the driver.
    """

    def checksum(e: DataFrame):
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    edges = materialise(edges.select("u", "v").where("u <> v").distinct(), name)
    seen = checksum(edges)
    while seen[0]:
        both = edges.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # written, for a plan of both halves is planned anew after each of its stages, in the driver's heap
        down = materialise(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), name)
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = least.select("u", F.col("m").alias("v")).union(down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        edges = materialise(small, name)
        last, seen = seen, checksum(edges)
        if seen == last:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())
