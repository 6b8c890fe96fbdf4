"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import written


def connected_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, root) for every node of the edges; root is the smallest node of its component.

    Each step replaces edges by edges to smaller nodes; only minima are gathered, never a node's neighbours, so a node of
    any degree is pre-aggregated before the shuffle. Minima are written before they meet the edges, so that join is one of two plain shuffles
    and Spark splits the rows of a node of high degree among tasks. Steps are written to the shared folder, and end when a step changes
    nothing. Loops and repeated edges are allowed; an empty table gives an empty table.
    """
    e = edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u <> v").distinct()
    e, last = written(e, "edges"), None
    while True:
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == last or not state[0]:
            break
        last = state
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = written(large, "edges")
        small = written(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        linked = large.join(small, "u")
        e = written(
            linked.select(F.col("v").alias("u"), F.col("m").alias("v")).union(linked.select("u", F.col("m").alias("v"))).where("u <> v").distinct(),
            "edges",
        )
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
