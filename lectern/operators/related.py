"""Related materials: weighted evidence shared with one seed material.

Every signal joins the seed's own few values against the attribute table, so
the large side streams past once, and connections stay rows: nothing is
collected per value or per candidate.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions.text import strip
from lectern.operators.ranking import best

SIGNAL = ("material_id", "type", "facet", "value")


def shared_attribute(rows: DataFrame, seed: int, key: str, kind: str, value: Column | None = None,
                     facet: Column | None = None) -> DataFrame:
    """Other materials holding one of the seed's values of ``key``.

    ``rows`` must be unique per (material, key): duplicates would multiply
    weights.
    """
    shown = value if value is not None else F.col(key)
    mine = rows.where(F.col("material_id") == seed).select(
        key, shown.cast("string").alias("value"), (facet if facet is not None else F.lit("")).alias("facet"))
    others = rows.where(F.col("material_id") != seed).select("material_id", key)
    return others.join(mine, key).select("material_id", F.lit(kind).alias("type"), "facet", "value")


def unpivot_facets(rows: DataFrame, facets: list[str], folded: bool = True) -> DataFrame:
    """(material, facet, value) rows; folded values compare trimmed, caseless."""
    long = rows.select("material_id", *facets).unpivot("material_id", facets, "facet", "value")
    if folded:
        long = long.withColumn("value", strip(F.coalesce("value", F.lit(""))))
    else:
        long = long.withColumn("value", F.coalesce("value", F.lit("")))
    return long.where(strip(F.col("value")) != "").withColumn(
        "facet_key", F.concat_ws("\u001f", "facet", F.lower("value") if folded else F.col("value")))


def shared_facets(rows: DataFrame, seed: int, facets: list[str], folded: bool = True) -> DataFrame:
    long = unpivot_facets(rows, facets, folded)
    return shared_attribute(long, seed, "facet_key", "shared_facet", F.col("value"), F.col("facet"))


def connection_label() -> Column:
    """Readable text of one connection."""
    kind, value = F.col("type"), F.col("value")
    facet = F.when(F.col("facet") != "", F.concat(F.lit(" ["), "facet", F.lit("]"))).otherwise("")
    return (
        F.when(kind == "shared_local_cluster", F.concat(F.lit("shared local home: "), value))
        .when(kind == "shared_global_cluster", F.concat(F.lit("shared bridge: "), value))
        .when(kind == "shared_concept", F.concat(F.lit("shared concept: "), value))
        .when(kind == "shared_keyword", F.concat(F.lit("shared keyword: "), value))
        .when(kind == "shared_author", F.concat(F.lit("shared author: "), value))
        .when(kind == "shared_facet", F.concat(F.lit("shared facet"), facet, F.lit(": "), value))
        .otherwise(F.concat(kind, F.lit(": "), value))
    )


def weigh(signals: list[DataFrame], weights: dict[str, float]) -> DataFrame:
    merged = reduce(DataFrame.unionByName, (s.select(*SIGNAL) for s in signals))
    table = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    return merged.withColumn("weight", F.coalesce(F.get(F.array(table[F.col("type")]), F.lit(0)), F.lit(0.0)))


def related(weighted: DataFrame, limit: int) -> DataFrame:
    """Best candidates by summed weight, ties by id."""
    scores = weighted.groupBy("material_id").agg(
        F.round(F.sum("weight"), 3).alias("score"), F.count(F.lit(1)).alias("connections"))
    return best(scores, limit, F.desc("score"), F.asc("material_id"))


def connections(weighted: DataFrame, top: DataFrame) -> DataFrame:
    """One row per connection of the chosen candidates."""
    return weighted.join(top.select("material_id", "rank"), "material_id").select(
        "material_id", "rank", connection_label().alias("label"))


def page_reasons(weighted: DataFrame, top: DataFrame, order: dict[str, int], keep: int = 5) -> DataFrame:
    """First distinct reasons per candidate, in signal order."""
    rank_of = F.create_map(*[F.lit(x) for pair in order.items() for x in pair])
    reason = (
        F.when(F.col("type") == "shared_local_cluster", F.concat(F.lit("shared concept: "), "value"))
        .when(F.col("type") == "shared_facet", F.concat(F.lit("shared "), F.replace("facet", F.lit("_"), F.lit(" ")), F.lit(": "), "value"))
        .otherwise(F.concat(F.replace("type", F.lit("_"), F.lit(" ")), F.lit(": "), "value"))
    )
    rows = weighted.join(top.select("material_id"), "material_id", "left_semi").select(
        "material_id", rank_of[F.col("type")].alias("_o"), reason.alias("reason"))
    distinct = rows.groupBy("material_id", "reason").agg(F.min("_o").alias("_o"))
    window = Window.partitionBy("material_id").orderBy("_o", "reason")
    return distinct.withColumn("n", F.row_number().over(window).cast("bigint")).where(F.col("n") <= keep).drop("_o")
