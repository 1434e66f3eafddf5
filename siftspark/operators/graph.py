"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import release, scratch


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node in a link; component is the smallest node of its component.

    Large-star and small-star steps in turn: each links a node's neighbours to the smallest of them, so
    long chains shrink in a logarithmic number of rounds. Minima fold before the shuffle; lineage is cut in
    the shared folder every round, and the loop ends when nothing changes. An empty table gives an empty one.
    """
    edges = links.where(f"`{a}` is not null and `{b}` is not null and `{a}` <> `{b}`")
    edges = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edges = scratch(edges, "links")
    mark = None
    while True:  # each round but the last moves links towards smaller nodes
        # Large star: every larger neighbour of u links to the smallest of u and its neighbours.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # Small star: u and its smaller neighbours link to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        before, edges = edges, scratch(small, "links")
        release(before)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == mark:
            break
        mark = tuple(now)
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(roots)
