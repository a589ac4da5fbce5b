"""Operators over (group, member) edge tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.fixed import RELEVANCE_POINTS


def relations_of(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(cluster, related cluster, shared material) rows for the seed clusters.

    Work is the seeds' members times the groups those members sit in; relations
    between clusters nobody asked about are never produced. ``edges`` must be
    distinct.
    """
    mine = edges.join(seeds, "cluster_id", "left_semi")
    others = edges.select(F.col("cluster_id").alias("related_cluster_id"), "material_id")
    return mine.join(others, "material_id").where("cluster_id != related_cluster_id").select(
        "cluster_id", "related_cluster_id", "material_id")


def overlapping(edges: DataFrame, group: str, member: str, seed: int) -> DataFrame:
    """Groups that share at least one member with the seed group."""
    mine = edges.where(F.col(group) == seed).select(member).distinct()
    return edges.where(F.col(group) != seed).join(mine, member, "left_semi").select(group).distinct()


def key_concepts(rows: DataFrame) -> DataFrame:
    """Material count and summed relevance points per concept key.

    Rows are unique per (material, key), so both are plain partial sums.
    """
    points = F.lit(0)
    for name, value in RELEVANCE_POINTS.items():
        points = F.when(F.lower("relevance") == name, value).otherwise(points)
    return rows.groupBy("concept_key").agg(
        F.count(F.lit(1)).alias("material_count"), F.sum(points).cast("bigint").alias("relevance_points"))


def first_source(sources: list[DataFrame], key: str) -> DataFrame:
    """One row per key from the first source that has it."""
    tagged = [s.withColumn("_pri", F.lit(i)) for i, s in enumerate(sources)]
    merged = reduce(DataFrame.unionByName, tagged)
    rest = [c for c in sources[0].columns if c != key]
    picked = merged.groupBy(key).agg(F.min_by(F.struct(*rest), "_pri").alias("_row"))
    return picked.select(key, *[F.col(f"_row.{c}").alias(c) for c in rest])
