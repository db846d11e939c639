"""Connected components of large graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corpusmill.llm.common import shuffles_removed, stored


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (``a, b``): ``root`` is the smallest node reachable.

    Alternates large-star and small-star steps: every node points its larger neighbours, then its smaller ones, at the
    smallest node around it, until all edges are stars. A step is an aggregation with map-side combining and a join
    that Spark can split (both sides of a hub's are tables); neighbour lists are never gathered, so a node may
    have any number of them.
    """
    edges = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while not _stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = stored(both.join(least, "u").filter("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        lower = large.groupBy("u").agg(F.min("v").alias("m"))  # hubs are smaller nodes, so no group is large here
        small = large.join(lower, "u").select(
            F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"),
        ).select("e.*").filter("u <> v").distinct()
        edges = stored(small)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def _stars(edges: DataFrame) -> bool:
    """No node has two smaller neighbours, and none that has one is another's smaller neighbour."""
    ends = edges.select("u", F.lit(1).alias("below"), F.lit(0).alias("above")).unionByName(
        edges.select(F.col("v").alias("u"), F.lit(0).alias("below"), F.lit(1).alias("above")))
    nodes = ends.groupBy("u").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
    with shuffles_removed(edges.sparkSession):
        return nodes.filter("below > 1 OR below = 1 AND above = 1").isEmpty()
