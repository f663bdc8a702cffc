"""Connected components over an edge table, without ever holding a component in one place.

Alternating large-star and small-star steps (Kiveris et al., "Connected
Components in MapReduce and Beyond", 2014).  Each is one aggregation and one
join on the node; a hub's neighbours are rows of a join, which is split where
it is skewed, never an array.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _star(edges: DataFrame, small: bool, tasks: int) -> DataFrame:
    """Link every node's neighbours to the least node about it."""
    if small:  # only neighbours below the node, and the node itself
        arcs = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    else:
        arcs = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    arcs = arcs.coalesce(tasks)
    least = arcs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
    linked = arcs.join(least, arcs["u"] == least["c"])
    # a node keeps its own link to the least
    own = least.select(F.col("c").alias("u"), F.col("m").alias("v"))
    moved = linked if small else linked.where(F.col("v") > F.col("u"))
    out = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(own)
    return out.where(F.col("u") != F.col("v")).coalesce(tasks)


def components(edges: DataFrame, most: int = 40, edges_per_task: int = 100_000) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v): root is the least node of its component.

    Loops and repeated edges don't matter; no edges give no rows.  A small
    graph is worked on in few tasks.  Rounds grow with the logarithm of a
    component's size; after ``most`` of them without an end it is an error
    rather than a result that isn't whole.
    """
    now = cut(edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    for _ in range(most):
        sign = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if sign == state or not sign[0]:
            break
        state = sign
        tasks = 1 + sign[0] // edges_per_task
        now = cut(_star(_star(now, False, tasks), True, tasks).distinct().coalesce(tasks))
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return cut(roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()))
