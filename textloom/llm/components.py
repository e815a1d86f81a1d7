"""Connected components of a graph held in a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stage


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for each node of an edge, component being the smallest node reachable.

    Alternates large-star and small-star (Kiveris et al., 2014): each step hangs a node's neighbours
    under its smallest one, as a group-by and a join of its result to the edges; the number of steps
    grows with the logarithm of the longest path. Only two checksums come to the driver. Edges with a
    null end and loops are ignored.
    """
    links = stage(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(f"{a} <> {b}").distinct()
    )
    before = None
    while True:
        both = links.union(links.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
            .union(least.select("u", F.col("m").alias("v")))
            .filter("u <> v")
            .distinct()
        )
        former, links = links, stage(small)
        discard(former)
        # XOR can't overflow; a set of edges that stays the same is final.
        now = links.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if now == before:
            break
        before = now
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
