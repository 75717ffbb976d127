"""Connected components by alternating large-star and small-star rounds; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small_enough

#: Neighbours from which a node is a hub: its edges stay where they are, and what is known of it goes to them. There
#: are at most (2 x edges / HUB) of these nodes.
HUB = 5_000
#: Rows up to which a table of nodes is broadcast (16 bytes each).
BROADCAST_ROWS = 200_000


def _told(rows: DataFrame, least: DataFrame) -> DataFrame:
    """rows(a, ...) with m, the least neighbour of a: least(a, m, n). No task gathers the rows of a hub."""
    least = cut(least)
    known = least.select("a", "m")
    if small_enough(known, BROADCAST_ROWS):
        return rows.join(F.broadcast(known), "a")
    hubs = least.where(F.col("n") >= HUB).select("a", "m")
    if not hubs.limit(1).count() or not small_enough(hubs, BROADCAST_ROWS):
        return rows.join(known, "a")
    near = rows.join(F.broadcast(hubs), "a")
    return near.unionByName(rows.join(F.broadcast(hubs.select("a")), "a", "left_anti").join(known, "a"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    return _told(both, least.select("a", F.least("a", "m").alias("m"), "n")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    least = down.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    to = _told(down, least).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return to.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b), any order, loops and repeats allowed -> (node, root): root is the least node of its component.

    Nodes without an edge to another node do not appear. The number of rounds grows with the logarithm of the
    longest chain. Each round ends in a checkpoint, so a lost executor costs one round at most.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        now = cut(_small_star(cut(_large_star(now))))
        sign = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if sign == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        seen = sign
