"""Connected components of a long-keyed edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymesh.session import cut


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges(u, v); component: its smallest node.

    Every round first links each node's larger neighbours to its smallest one,
    then its smaller neighbours to that, until the edges are stars; both steps
    are a minimum per node and a join back, so a node of any degree is spread by
    its edges, not gathered. Self-links and repeats are allowed; no edges give
    no rows.
    """
    e = cut(edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        nxt = small.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        nxt = cut(nxt)
        # stars: no centre has a link of its own and no node has two centres
        loose = nxt.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").select("u").union(nxt.select(F.col("v").alias("u")).distinct().join(nxt.select("u"), "u", "left_semi"))
        e = nxt
        if loose.isEmpty():
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
