"""Removing materials from every store: what it would touch, and the stores without them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.names import material_path
from lectern.operators.tables import spread, stored

SHARE = 500_000  # members of clusters that one task holds, about
STORES = ("manifest", "extracted", "pages", "clusters", "members")


def _asked(asked: DataFrame) -> DataFrame:
    return asked.select(F.trim("material_id").alias("material_id")).where("material_id <> ''").distinct()


def _hit(stores: dict[str, DataFrame], ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Clusters that hold an asked material, with whether they collapse; pages that go."""
    members = stores["members"].select("cluster_id", "material_id").where("material_id is not null")
    # dealt once, by material: which pairs are asked for, and repeats of a pair, are settled in the task that holds it
    dealt = spread(members, stores["members"].count(), "material_id", share=SHARE)
    pairs = dealt.join(ids.withColumn("_asked", F.lit(True)), "material_id", "left").distinct()
    counts = pairs.groupBy("cluster_id").agg(F.count("_asked").alias("_gone"), F.count_if(F.col("_asked").isNull()).alias("_left"))
    # written once, as every part of a report or of the stores afterwards asks for it
    hit = stored(stores["clusters"].join(counts.where("_gone > 0"), "cluster_id").select(
        "cluster_id", "wiki_path", "file", (F.col("_left") < 2).alias("collapses")), "removal-hit")
    scopes = stores["manifest"].select("material_id", "domain", "collection", F.lit(1).alias("n")).unionByName(
        stores["extracted"].select("material_id", "domain", "collection", F.lit(0).alias("n")))
    known = scopes.join(ids, "material_id", "left_semi").groupBy("material_id").agg(F.min_by(F.struct("domain", "collection"), "n").alias("s"))
    paths = known.select(material_path(F.col("s.domain"), F.col("s.collection"), F.col("material_id")).alias("path")).union(
        hit.where("collapses").select("wiki_path"))
    return hit, stores["pages"].join(paths.distinct(), "path", "left_semi").select("path")


def report(stores: dict[str, DataFrame], asked: DataFrame) -> DataFrame:
    """kind and id of all that a removal finds and touches; nothing is changed.

    manifest, extracted: material_id, domain, collection (what was extracted rules a page's place). pages: path. clusters:
    cluster_id, wiki_path, file. members: cluster_id, material_id.
    """
    ids = _asked(asked)
    hit, pages = _hit(stores, ids)
    listed = stores["manifest"].select("material_id").join(ids, "material_id", "left_semi")
    folders = stores["extracted"].select("material_id").join(ids, "material_id", "left_semi")
    parts = [
        ("removed material", listed),
        ("missing material", ids.join(listed, "material_id", "left_anti").join(folders, "material_id", "left_anti")),
        ("touched path", folders.select(F.concat(F.lit("extracted/"), "material_id"))),
        ("touched path", pages), ("collapsed cluster", hit.where("collapses").select("cluster_id")),
        ("rewritten file", hit.select("file").distinct()), ("touched path", hit.select("file").distinct())]
    return reduce(DataFrame.union, [rows.select(F.lit(kind).alias("kind"), F.col(rows.columns[0]).alias("id")) for kind, rows in parts])


def without(stores: dict[str, DataFrame], asked: DataFrame) -> dict[str, DataFrame]:
    """All stores after the removal, to be published together."""
    ids = _asked(asked)
    hit, pages = _hit(stores, ids)
    gone = hit.where("collapses").select("cluster_id")
    return {
        "manifest": stores["manifest"].join(ids, "material_id", "left_anti"), "extracted": stores["extracted"].join(ids, "material_id", "left_anti"),
        "pages": stores["pages"].join(pages, "path", "left_anti"), "clusters": stores["clusters"].join(gone, "cluster_id", "left_anti"),
        "members": stores["members"].join(ids, "material_id", "left_anti").join(gone, "cluster_id", "left_anti")}
