"""Connected components of an edge table, by alternating large and small stars.

Every round hangs each node's larger neighbours, then its smaller ones, on the smallest
node that it sees; edges stay distinct and only shrink in number. The table is written
to the shared folder after each round, so that a lost executor costs one round at most.
Nothing but a count and a checksum comes back to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored


#: Edges of a node from which it is a hub, at least, and hubs at most: with more edges the first bound grows.
HUB, HUBS = 1_000, 100_000


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    """u and the smallest node that its smaller neighbour v sees, over edges u > v, of which there are total.

    A node that many others hang on is met by a broadcast, not by a shuffle of its edges
    to one task; there are total / bound hubs at most.
    """
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("v"), "m")
    bound = max(HUB, total // HUBS)
    hubs = edges.groupBy("v").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > bound).select("v")
    many = edges.join(F.broadcast(hubs.join(least, "v", "left")), "v")
    few = edges.join(F.broadcast(hubs), "v", "left_anti").join(least, "v", "left")
    return many.unionByName(few).select("u", F.coalesce("m", "v").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    hung = down.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """node and component (its smallest node) of every node but the smallest of each component.

    edges: u and v, in either order; loops and repeats do no harm.
    """
    now = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct(), name)
    seen = None
    while True:
        mark = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if not mark[0] or mark == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        seen = mark
        now = stored(_small_star(_large_star(now, mark[0])), name)
