"""Connected components by repeated hooking and pointer jumping, on tables only.

Each round every vertex takes its least neighbour as parent if that is less than itself; pointers are jumped until they
reach roots; edges are moved to roots and loops dropped. Vertices with edges at least halve each round. Every shuffle
is a min-aggregate or a join with one row a vertex, so a hub with many edges is combined before it is sent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """edges (a, b) of longs -> (v, root): for each vertex with an edge, the least vertex of its component."""
    live = edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a < b").distinct()
    live = checkpointed(live)
    done = None
    while live.take(1):
        # the greater end of each edge may hook on its least neighbour; roots are vertices without a lesser neighbour
        up = live.groupBy(F.col("b").alias("v")).agg(F.min("a").alias("p"))
        tree = checkpointed(up)
        while True:
            parents = tree.select(F.col("v").alias("_v"), F.col("p").alias("_p"))
            jumped = checkpointed(tree.join(parents, F.col("p") == F.col("_v"), "left").select("v", F.coalesce("_p", "p").alias("p"), F.col("_p").isNotNull().alias("moved")))
            tree = jumped.select("v", "p")
            if not jumped.where("moved").take(1):
                break
        root = tree.select(F.col("v").alias("_v"), F.col("p").alias("_r"))
        if done is None:
            done = tree
        else:
            moved = done.join(root, F.col("p") == F.col("_v"), "left").select("v", F.coalesce("_r", "p").alias("p"))
            done = moved.unionByName(tree.join(moved.select("v"), "v", "left_anti"))
        side = live.join(root, F.col("a") == F.col("_v"), "left").select(F.coalesce("_r", "a").alias("a"), "b")
        side = side.join(root, F.col("b") == F.col("_v"), "left").select("a", F.coalesce("_r", "b").alias("b"))
        live = checkpointed(side.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
        done = checkpointed(done)
    if done is None:
        return live.select(F.col("a").alias("v"), F.col("b").alias("root"))
    found = done.select("v", F.col("p").alias("root"))
    return found.unionByName(found.select(F.col("root").alias("v"), "root").distinct())
