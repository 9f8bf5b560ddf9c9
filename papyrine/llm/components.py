"""Connected components of a distributed edge list by alternating large-star and small-star steps.

Defined results: links with a null end, self links and repeated links are ignored; an empty list gives none.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrine.llm.common import materialise, release


#: Edges that one task writes: small tables are written by few tasks, large ones by many.
EDGES_A_TASK = 500_000


def _settled(edges: DataFrame) -> bool:
    """Whether every node has one edge and leads to a node that has none: then each leads to its component's smallest."""
    heads = edges.select(F.col("v").alias("u")).distinct()
    open_ = edges.join(heads, "u", "left_semi").select("u").limit(1)
    twice = edges.groupBy("u").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("u").limit(1)
    return not open_.unionByName(twice).head(1)


def connected_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, root) for every node of ``edges``; root is the smallest node reachable.

    Each step aggregates a minimum per node (combined before the shuffle) and joins it back, so a
    hub is never gathered in one task. The edge table is written to the shared folder each round;
    the number of rounds grows with the logarithm of the longest chain. An empty edge list gives an
    empty result; self links and repeated links are ignored.
    """
    edges = edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).filter("u <> v").distinct()
    edges = materialise(edges, "edges")
    tasks = 1 + edges.count() // EDGES_A_TASK
    while not _settled(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        new = materialise(small.filter("u > v").distinct().coalesce(tasks), "edges")
        release(edges)
        edges = new
    roots = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
