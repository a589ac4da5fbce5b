"""Connected components of a distributed edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above u is tied to the smallest vertex among u and its neighbours."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """u and its neighbours below it are tied to the smallest of these; edges come as u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u")
    return (moved.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(least.select("u", F.col("m").alias("v"))).distinct())


def _all_stars(edges: DataFrame) -> bool:
    """Whether every vertex has one parent or is one, but not both."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("child"), F.lit(0).alias("parent")).union(
        edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("x").agg(F.sum("child").alias("child"), F.max("parent").alias("parent")).where(
        "child > 1 or (child = 1 and parent = 1)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(u, v) of any orientation -> (vertex, component), the smallest vertex of each component naming it.

    Vertices without an edge to another vertex do not appear. Edges only move towards smaller vertices until every
    component is a star around its smallest; one yes or no a round reaches the driver. Null ends are ignored.
    """
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    while True:
        edges = stored(_small_star(_large_star(edges)), "stars")
        if _all_stars(edges):
            return edges.select(F.col("u").alias("vertex"), F.col("v").alias("component")).union(
                edges.select(F.col("v").alias("vertex"), F.col("v").alias("component")).distinct())
