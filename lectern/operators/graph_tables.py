"""The concept graph's tables, built anew from their inputs and published together.

Inputs are rows with a `position` in reading order. Where an input repeats a key, the later row replaces the earlier one
(the earlier one stays for aliases and for the materials of a cluster). Relations between clusters are built for the
clusters of `seeds` only: all of them grow with the square of the clusters that share a material.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import names as N
from lectern.operators.graph import relations_of
from lectern.operators.tables import stored

TABLES = ("clusters", "aliases", "cluster_materials", "relations", "bridge_members", "bridges", "reviews",
          "concept_reflections", "collection_reflections", "findings", "pages")


def _named(value: str) -> Column:
    return F.trim(F.coalesce(F.col(value), F.lit(""))) != ""


def _one(rows: DataFrame, key: list[str], pick=F.max_by) -> DataFrame:
    """One row per key, the last one by position (or the first, with min_by); partial aggregates, no window."""
    rest = [c for c in rows.columns if c not in key]
    chosen = rows.groupBy(*key).agg(pick(F.struct(*rest), "position").alias("r"))
    return chosen.select(*key, *[F.col(f"r.{c}").alias(c) for c in rest])


def _given_or(path: str, built: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(path), F.lit("")), built)


def local_tables(clusters: DataFrame, aliases: DataFrame, sources: DataFrame, materials: DataFrame, seeds: DataFrame
                 ) -> dict[str, DataFrame]:
    """clusters: cluster_id, domain, collection, canonical_name, slug, confidence, wiki_path, position.
    aliases: cluster_id, alias, position. sources: cluster_id, material_id, relevance, confidence, position."""
    kept = _one(clusters.where(_named("cluster_id")), ["cluster_id"])
    held = _one(sources.where(_named("cluster_id") & _named("material_id")), ["cluster_id", "material_id"], F.min_by)
    # written once: counts, pages' places and relations are all told from it
    held = stored(held.join(kept.select("cluster_id"), "cluster_id", "left_semi").select("cluster_id", "material_id", "relevance", "confidence"), "held")
    counts = held.groupBy("cluster_id").agg(F.count("*").alias("material_count"))
    domain, collection = N.domain_or_default(F.col("domain")), N.collection_or_default(F.col("collection"))
    info = materials.select("material_id", "domain", "collection")
    return {
        "clusters": kept.join(counts, "cluster_id", "left").select(
            "cluster_id", domain.alias("domain"), collection.alias("collection"), "canonical_name", "slug", "confidence",
            _given_or("wiki_path", N.concept_path(F.col("domain"), F.col("collection"), F.col("slug"))).alias("wiki_path"),
            F.coalesce("material_count", F.lit(0)).alias("material_count")),
        "aliases": aliases.where(_named("alias")).join(kept.select("cluster_id"), "cluster_id", "left_semi").select(
            "cluster_id", "alias").distinct(),
        "cluster_materials": held.join(info, "material_id", "left").select(
            "cluster_id", "material_id", "relevance", "confidence",
            N.material_path(F.col("domain"), F.col("collection"), F.col("material_id")).alias("material_wiki_path")),
        "relations": relations_of(held.select("cluster_id", "material_id"), seeds).groupBy("cluster_id", "related_cluster_id").agg(
            F.count("*").alias("shared_material_count")),
    }


def bridge_tables(bridges: DataFrame, supports: DataFrame, members: DataFrame) -> dict[str, DataFrame]:
    """bridges: bridge_id, domain, canonical_name, slug, descriptor, confidence, wiki_path, position. supports: bridge_id,
    material_id. members: bridge_id, cluster_id, domain, collection, wiki_path, position, material_id (a row per material)."""
    kept = _one(bridges.where(_named("bridge_id")), ["bridge_id"])
    counts = supports.where(_named("material_id")).groupBy("bridge_id").agg(F.count_distinct("material_id").alias("material_count"))
    several = F.coalesce("material_count", F.lit(0)) > 1
    path = F.when(several, N.bridge_path(F.col("domain"), F.col("slug"))).otherwise(
        F.concat(F.lit("wiki/shared/concepts/"), F.col("slug"), F.lit(".md")))
    member = members.where(_named("bridge_id") & _named("cluster_id"))
    last = member.groupBy("bridge_id", "cluster_id").agg(F.max_by(F.struct("domain", "collection", "wiki_path"), "position").alias("r"), F.count_distinct(
        F.when(_named("material_id"), F.trim("material_id"))).alias("material_count"))
    return {
        "bridges": kept.join(counts, "bridge_id", "left").select(
            "bridge_id", F.trim(F.coalesce("domain", F.lit(""))).alias("domain"), "canonical_name", "slug", "descriptor", "confidence",
            _given_or("wiki_path", path).alias("wiki_path"), F.coalesce("material_count", F.lit(0)).alias("material_count")),
        "bridge_members": last.select("bridge_id", "cluster_id", "r.domain", "r.collection", F.col("r.wiki_path").alias("local_wiki_path"),
                                      "material_count"),
    }


def note_tables(reviews: DataFrame, concepts: DataFrame, collections: DataFrame, findings: DataFrame) -> dict[str, DataFrame]:
    """Reviews are keyed by the first id they have: of the review, the cluster or the finding."""
    keyed = reviews.withColumn("review_id", F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("review_id", "cluster_id", "finding_id")]))
    return {
        "reviews": _one(keyed.where("review_id is not null"), ["review_id"]).drop("finding_id", "position"),
        "concept_reflections": _one(concepts.where(_named("cluster_id")), ["cluster_id"]).drop("position"),
        "collection_reflections": _one(collections.where(_named("domain") & _named("collection")), ["domain", "collection"]).drop("position"),
        "findings": _one(findings.where(_named("finding_id")), ["finding_id"]).drop("position"),
    }


def page_registry(clusters: DataFrame, bridges: DataFrame, materials: DataFrame) -> DataFrame:
    """page_type, page_id, title, path, domain, collection of every page; a local cluster's page replaces a bridge's."""
    domain, collection = N.domain_or_default(F.col("domain")), N.collection_or_default(F.col("collection"))
    text = lambda c: F.lit(c)
    concept = bridges.where("material_count > 1").select(
        F.col("bridge_id").alias("page_id"), F.col("canonical_name").alias("title"), F.col("wiki_path").alias("path"),
        N.default_scope(F.col("domain"), "shared").alias("domain"), text("bridge-concepts").alias("collection"), F.lit(0).alias("position"))
    local = clusters.select(F.col("cluster_id").alias("page_id"), F.col("canonical_name").alias("title"), F.col("wiki_path").alias("path"),
                            "domain", "collection", F.lit(1).alias("position"))
    concepts = _one(concept.union(local), ["page_id"]).select(text("concept").alias("page_type"), "page_id", "title", "path", "domain", "collection")
    scoped = materials.select(domain.alias("domain"), collection.alias("collection"), "material_id", "title")
    pages = scoped.select(text("material").alias("page_type"), F.col("material_id").alias("page_id"), "title",
                          N.material_path(F.col("domain"), F.col("collection"), F.col("material_id")).alias("path"), "domain", "collection")
    groups = scoped.select("domain", "collection").distinct().select(
        text("collection").alias("page_type"), F.concat_ws("/", "domain", "collection").alias("page_id"),
        N.collection_title(F.col("domain"), F.col("collection")).alias("title"),
        F.concat(F.lit("wiki/"), F.concat_ws("/", "domain", "collection"), F.lit("/_index.md")).alias("path"), "domain", "collection")
    fixed = clusters.sparkSession.range(1).select(F.inline(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(pages.columns, row)]) for row in (
        ("concept_index", "local", "Local Concepts", "wiki/shared/concepts/_index.md", "shared", "concepts"),
        ("glossary", "bridge", "Main Concepts", "wiki/shared/glossary/_index.md", "shared", "glossary"))])))
    return reduce(DataFrame.unionByName, (concepts, pages, groups, fixed))


def graph_tables(local: dict[str, DataFrame], bridge: dict[str, DataFrame], notes: dict[str, DataFrame], materials: DataFrame
                 ) -> dict[str, DataFrame]:
    """All of TABLES."""
    built = {**local, **bridge, **notes}
    built["pages"] = page_registry(built["clusters"], built["bridges"], materials)
    return {name: built[name] for name in TABLES}
