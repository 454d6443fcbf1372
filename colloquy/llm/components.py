"""Connected components of an edge table, in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, saved

#: Rounds halve the distance to the smallest member at least; 60 are enough for any graph that fits a cluster.
MOST_ROUNDS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step of the large-star and small-star algorithm (Kiveris et al., 2014) over saved edges (u > v)."""
    sides = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = saved(sides.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "least")
    total = least.agg(F.sum("n")).first()[0] or 0
    near = attach(sides, least, "u", "n", total)
    m = F.least("u", "m")
    if large:
        out = near.where("v > u").select(F.col("v").alias("u"), m.alias("v"))
    else:
        out = near.select(F.explode(F.array(F.struct("u", m.alias("v")), F.struct(F.col("v").alias("u"), m.alias("v")))).alias("e")).select("e.u", "e.v")
    return out.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (u, v): root is the smallest node that it reaches.

    Loops and repeated edges do no harm; rows with a null end are left out; no edges give no rows.
    """
    e = saved(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    was = None
    for _ in range(MOST_ROUNDS):
        # stable once the edges are stars: equal number, and equal sum of hashes, before and after
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if tuple(now) == was or not now[0]:
            break
        was = tuple(now)
        e = saved(_star(saved(_star(e, True), "large"), False), "small")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
