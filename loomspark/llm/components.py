"""Connected components of a graph that is a table of edges, by turns of large-star and small-star.

Large-star links every larger neighbour of a vertex to the smallest of the vertex and its neighbours; small-star does
the same with the vertex and its smaller neighbours. Repeated, they leave stars around each component's smallest
vertex, in a number of rounds that grows with the logarithm of the number of vertices. Edges stay a table throughout;
each round's table is written to the shared folder, and the one before it is deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm.common import discard, written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("hi").alias("v"), F.col("lo").alias("w")).unionAll(edges.select(F.col("lo").alias("v"), F.col("hi").alias("w")))
    least = both.groupBy("v").agg(F.least(F.min("w"), F.col("v")).alias("m"))
    # a larger neighbour w of v goes to v's smallest: exactly the edges (hi=w, lo=v)
    return edges.join(least, edges["lo"] == least["v"]).select("hi", F.col("m").alias("lo")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("hi").agg(F.min("lo").alias("m"))
    joined = edges.join(least, "hi")
    moved = joined.where("lo != m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return moved.unionAll(least.select("hi", F.col("m").alias("lo"))).distinct()


def _all_stars(edges: DataFrame) -> bool:
    """Whether no vertex is both an end and a centre, and no end has two centres."""
    ends = edges.select(F.col("hi").alias("v"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    centres = edges.select(F.col("lo").alias("v"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    sums = ends.unionAll(centres).groupBy("v").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return sums.where("up > 1 OR (up = 1 AND down = 1)").isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of longs, in any direction, loops allowed -> (vertex, component) for each vertex with an edge to
    another one, except the components' own smallest vertices."""
    tidy = edges.where("a != b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    now = written(tidy, "component-edges")
    while not _all_stars(now):
        wide = written(_large_star(now), "component-edges")
        discard(now)
        now = written(_small_star(wide), "component-edges")
        discard(wide)
    return now.select(F.col("hi").alias("vertex"), F.col("lo").alias("component"))
