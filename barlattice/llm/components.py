"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlattice.llm.common import settled


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of a link; the component is its smallest node.

    Alternating star steps: every node hands its larger neighbours to its smallest neighbour, then
    every node hands its smaller ones to the smallest. Each step is one aggregation and one join of
    the links; their number grows with the logarithm of the longest path. Links to a hub are one row
    each, so a large group has no task of its own beyond the sum of its rows.
    """
    edges = settled(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
                    .filter("u <> v").distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = large.join(low, "u")
        small = (pairs.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        new = settled(small)
        same = edges.join(new, ["u", "v"], "left_anti").isEmpty() and new.join(edges, ["u", "v"], "left_anti").isEmpty()
        edges = new
        if same:
            break
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
