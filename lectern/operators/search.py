"""Faceted, multi-depth search assembled from ranked hit tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions.fixed import (
    ANNOTATION_BOOST, COMMENTED_BOOST, CONCEPT_BOOST, EMPHASIS_BOOST, SEARCH_FACETS,
)
from lectern.operators.ranking import best, best_per


def facet_filter(facets: list[str], collection: str | None = None) -> Column:
    """Conjunction of ``name=part`` (contains) and ``name==value`` (equals) facets."""
    wanted = list(facets) + ([f"collection={collection}"] if collection else [])
    tests: list[Column] = [F.lit(True)]
    for text in wanted:
        exact = "==" in text
        name, _, value = text.partition("==" if exact else "=")
        name, value = name.strip(), value.strip()
        if name not in SEARCH_FACETS:
            continue
        if exact:
            tests.append(F.col(name) == value)
        else:
            tests.append(F.lower(name).like(f"%{value.lower()}%"))
    return reduce(lambda a, b: a & b, tests)


def facets_in_domain(facets: list[str], domain: str) -> list[str]:
    """Replace the caller's exact domain facet with the active domain."""
    kept = [f for f in facets if not f.replace(" ", "").startswith("domain==")]
    return kept + [f"domain=={domain}"]


def cards(hits: DataFrame, key: str, limit: int) -> DataFrame:
    """Ranked cards: best score first, key as the tie-break."""
    return best(hits, limit, F.col("score").desc(), F.col(key).asc())


def top_chunks(hits: DataFrame, group: str, key: str, limit: int) -> DataFrame:
    boosted = F.col("score") + F.when(F.col("emphasized"), EMPHASIS_BOOST).otherwise(0.0)
    return best_per(hits, group, limit, boosted.desc(), F.col(key).asc())


def top_annotations(hits: DataFrame, group: str, key: str, limit: int) -> DataFrame:
    commented = F.when(F.col("comment") == "", 1).otherwise(0)
    return best_per(hits, group, limit, commented.asc(), F.col("score").desc(), F.col(key).asc())


def top_plain(hits: DataFrame, group: str, key: str, limit: int) -> DataFrame:
    return best_per(hits, group, limit, F.col("score").desc(), F.col(key).asc())


def content_candidates(sources: list[DataFrame], key: str, limit: int) -> DataFrame:
    """Materials found through content, in source order then key order.

    Each source is cut to ``limit`` distinct materials before the union, so
    the ranking below sees at most ``limit`` rows per source.
    """
    cut = [
        s.select(key).distinct().orderBy(key).limit(limit).withColumn("_source", F.lit(i))
        for i, s in enumerate(sources)
    ]
    merged = reduce(DataFrame.unionByName, cut)
    first = merged.groupBy(key).agg(F.min("_source").alias("source_order"))
    order = [F.col("source_order").asc(), F.col(key).asc()]
    return first.withColumn("position", F.row_number().over(Window.orderBy(*order)).cast("bigint"))


def append_content(card_rows: DataFrame, candidates: DataFrame, allowed: DataFrame, key: str) -> DataFrame:
    """Cards followed by content-only materials that pass the facets.

    Candidates were limited before this filter, so fewer rows may survive.
    """
    extra = candidates.join(card_rows.select(key), key, "left_anti").join(allowed.select(key), key, "left_semi")
    merged = card_rows.select(key, F.lit(0).alias("_late"), F.col("rank").alias("_at")).unionByName(
        extra.select(key, F.lit(1).alias("_late"), F.col("position").alias("_at"))
    )
    order = Window.orderBy("_late", "_at")
    return merged.select(key, F.row_number().over(order).cast("bigint").alias("ordinal"))


def rerank(ordered: DataFrame, chunk_hits: DataFrame, annotation_hits: DataFrame,
           concept_hits: DataFrame, key: str) -> DataFrame:
    """Re-rank by ordinal minus evidence boosts over the truncated hit lists."""
    boosts = reduce(
        DataFrame.unionByName,
        [
            annotation_hits.select(key, F.when(F.col("comment") != "", COMMENTED_BOOST).otherwise(ANNOTATION_BOOST).alias("boost")),
            chunk_hits.where("emphasized").select(key, F.lit(EMPHASIS_BOOST).alias("boost")),
            concept_hits.select(key, F.lit(CONCEPT_BOOST).alias("boost")),
        ],
    )
    wanted = boosts.groupBy(key).agg(F.sum("boost").alias("boost"))
    scored = ordered.join(wanted, key, "left").withColumn(
        "priority", F.round(F.col("ordinal") - F.coalesce("boost", F.lit(0.0)), 6)
    )
    return scored.select(
        key, "ordinal", "priority",
        F.row_number().over(Window.orderBy("priority", "ordinal")).cast("bigint").alias("rank"),
    )


def like_any(columns: list[Column], query: str) -> Column:
    """Case-folded substring test over several columns; % and _ stay wildcards."""
    pattern = f"%{query.strip().lower()}%"
    return reduce(lambda a, b: a | b, (F.lower(F.coalesce(c, F.lit(""))).like(pattern) for c in columns))


def hits_then_fallback(primary: DataFrame, fallback: DataFrame, key: str, limit: int,
                       primary_order: list[Column], fallback_order: list[Column]) -> DataFrame:
    """Full-text hits first, substring hits after, one row per key, at most ``limit``.

    Both branches are cut to ``limit`` rows before they meet.
    """
    a = best(primary, limit, *primary_order, rank="_at").withColumn("_late", F.lit(0))
    b = best(fallback, limit, *fallback_order, rank="_at").withColumn("_late", F.lit(1))
    both = a.unionByName(b, allowMissingColumns=True)
    first = Window.partitionBy(key).orderBy("_late", "_at")
    one = both.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    order = Window.orderBy("_late", "_at")
    return (
        one.withColumn("rank", F.row_number().over(order).cast("bigint"))
        .where(F.col("rank") <= limit)
        .withColumn("matched_by", F.when(F.col("_late") == 0, "terms").otherwise("substring"))
        .drop("_late", "_at", "_n")
    )
