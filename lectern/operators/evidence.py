"""Evidence selection: weights, budgets and per-material samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def material_weights(sources: DataFrame, bonus: dict[str, float]) -> DataFrame:
    """Summed confidence, relevance bonus and span bonus per (cluster, material)."""
    extra: Column = F.lit(0.0)
    for level, value in bonus.items():
        extra = F.when(F.lower("relevance") == level, value).otherwise(extra)
    one = F.col("confidence") + extra + F.least("spans", F.lit(4)) * 0.02
    return sources.groupBy("cluster_id", "material_id").agg(F.round(F.sum(one), 6).alias("weight"))


def chunk_budget(weights: DataFrame, total: int, cap: int) -> DataFrame:
    """Share a chunk budget over a cluster's materials, heaviest first.

    A cluster with more materials than budget gives one chunk to the first
    ``total``; so only ranks up to ``total`` ever matter, the ranking is pruned
    to them before its shuffle, and the rest of the rows get zero.
    """
    sizes = weights.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))
    window = Window.partitionBy("cluster_id").orderBy(F.desc("weight"), F.desc("material_id"))
    ranked = weights.withColumn("rn", F.row_number().over(window)).where(F.col("rn") <= total)
    base = F.floor(F.lit(total) / F.col("n"))
    share = F.when(base > 0, F.least(F.lit(cap), base + F.when(F.col("rn") <= F.lit(total) % F.col("n"), 1).otherwise(0))).otherwise(1)
    given = ranked.join(sizes, "cluster_id").select("cluster_id", "material_id", share.cast("bigint").alias("chunk_limit"))
    return weights.select("cluster_id", "material_id").join(given, ["cluster_id", "material_id"], "left").select(
        "cluster_id", "material_id", F.coalesce("chunk_limit", F.lit(0).cast("bigint")).alias("chunk_limit"))


def sample_per(rows: DataFrame, group: str, keep: int, *order: Column) -> DataFrame:
    """First ``keep`` rows of every group in the given order, numbered."""
    window = Window.partitionBy(group).orderBy(*order)
    return rows.withColumn("rn", F.row_number().over(window).cast("bigint")).where(F.col("rn") <= keep)
