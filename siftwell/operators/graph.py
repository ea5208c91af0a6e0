"""Connected components over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.session import cut_lineage


#: Nodes of more than 1 / SPREAD of the ends of all edges, and over LIGHT, are hubs; there are never more than SPREAD of them.
SPREAD, LIGHT = 50_000, 64


def _with(edges: DataFrame, by_node: DataFrame, size: int) -> DataFrame:
    """Edges joined with the row of their node u. Hubs' rows, bounded in number, are broadcast, so no task gets all edges of a hub."""
    heavy = F.col("degree") > max(LIGHT, size // SPREAD)
    hubs, others = by_node.where(heavy).drop("degree"), by_node.where(~heavy).drop("degree")
    light = edges.join(F.broadcast(hubs.select("u")), "u", "left_anti").join(others, "u")
    return light.unionByName(edges.join(F.broadcast(hubs), "u"))


def _stars_only(edges: DataFrame) -> bool:
    """Whether every node has one edge to a root, and no root an edge to another."""
    roles = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(edges.select("v", F.lit(0), F.lit(1)))
    by_node = roles.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return by_node.where("up > 1 or (up = 1 and down = 1)").isEmpty()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (the smallest node that can be reached) for every node of an edge; rows with a null end don't count.

    Rounds of large-star and small-star, about the logarithm of the longest chain of them. Every exchange is by node with the
    minimum combined before it, or a join that hubs don't take part in; each round is written to the shared checkpoint folder.
    """
    ends = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"{a} is not null and {b} is not null")
    loops = cut_lineage(ends.distinct())
    now, size = loops.where("u <> v"), 2 * loops.count()
    while True:
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.count("*").alias("degree"), F.least(F.min("v"), F.first("u")).alias("m"))
        large = _with(both, least, size).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = large.groupBy("u").agg(F.count("*").alias("degree"), F.min("v").alias("m"))
        moved = _with(large, small, size).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = moved.unionAll(small.select("u", F.col("m").alias("v")))
        now = cut_lineage(now.where("u <> v").distinct(), size)  # a round never has more edges than ends
        if _stars_only(now):
            break
    roots = loops.select("u").unionAll(loops.select("v")).distinct().withColumnRenamed("u", "node")
    # at the end every node has one edge, to the smallest one of its component
    return roots.join(now.withColumnRenamed("u", "node"), "node", "left").select("node", F.coalesce("v", "node").alias("component"))
