"""Bridges over local clusters: what is pending, what is due, and merging a reflection into a bridge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.lists import canonical_hash, dedupe_folded

#: Most entries of each list of a bridge.
LIST_LIMITS = {"aliases": 8, "takeaways": 6, "tensions": 6, "open_questions": 6, "new_sources": 6}
SCALARS = ("canonical_name", "descriptor", "why")


def pending_inputs(clusters: DataFrame, previous: DataFrame, members: DataFrame) -> DataFrame:
    """Local clusters that bridging has to look at, with the first reason that holds.

    clusters: cluster_id, domain, and what a snapshot shows. previous: cluster_id, fingerprint. members: cluster_id and
    domain of what existing bridges hold. The fingerprint covers all columns of a snapshot.
    """
    shown = [c for c in clusters.columns]
    rows = clusters.withColumn("fingerprint", canonical_hash(*[F.col(c) for c in shown]))
    bridged = members.select("domain").distinct().withColumn("_bridged", F.lit(True))
    placed = members.select("cluster_id").distinct().withColumn("_placed", F.lit(True))
    before = previous.select("cluster_id", F.col("fingerprint").alias("_before"))
    reason = (
        F.when(F.col("_bridged").isNull(), "no bridges yet")
        .when(~F.col("fingerprint").eqNullSafe(F.col("_before")), "changed")
        .when(F.col("_placed").isNull(), "in no bridge"))
    joined = rows.join(bridged, "domain", "left").join(placed, "cluster_id", "left").join(before, "cluster_id", "left")
    return joined.withColumn("reason", reason).where("reason IS NOT NULL").select(*shown, "fingerprint", "reason")


def reflections_due(bridges: DataFrame, changed: DataFrame) -> DataFrame:
    """Bridges to reflect on: changed in this run, without prose, or with another fingerprint than the stamp's.

    bridges: bridge_id, why, stamp, fingerprint. changed: bridge_id.
    """
    marked = bridges.join(changed.select("bridge_id").distinct().withColumn("_changed", F.lit(True)), "bridge_id", "left")
    reason = (
        F.when(F.col("_changed"), "changed").when(F.trim(F.coalesce("why", F.lit(""))) == "", "no prose")
        .when(~F.col("stamp").eqNullSafe(F.col("fingerprint")), "stale stamp"))
    return marked.withColumn("reason", reason).where("reason IS NOT NULL").select("bridge_id", "reason")


def reflected(bridges: DataFrame, reflections: DataFrame) -> DataFrame:
    """Bridges with a reflection merged in: text replaces text unless it is blank, a list replaces a list unless it is
    empty once blanks and repeats are out, and is cut to its limit."""
    fields = [*SCALARS, *LIST_LIMITS]
    given = reflections.select("bridge_id", *[F.col(f).alias(f"_new_{f}") for f in fields])

    def scalar(name: str) -> Column:
        return F.coalesce(F.nullif(F.trim(f"_new_{name}"), F.lit("")), F.col(name)).alias(name)

    def listed(name: str, limit: int) -> Column:
        values = dedupe_folded(F.coalesce(f"_new_{name}", F.array().cast("array<string>")))
        return F.when(F.size(values) > 0, F.slice(values, 1, limit)).otherwise(F.col(name)).alias(name)

    return bridges.join(given, "bridge_id", "left").select(
        "bridge_id", *[scalar(f) for f in SCALARS], *[listed(f, n) for f, n in LIST_LIMITS.items()])


def collection_notes(stored: DataFrame, given: DataFrame, valid: DataFrame) -> DataFrame:
    """Notes of bridges after a response: bridge_id, collection_key, why, position.

    given: bridge_id, collection_key, why, position; valid: bridge_id, collection_key of the bridge's collections. Keys
    are trimmed; those that the bridge doesn't have are left out, and the first note of a key counts, blank or not. A
    response whose list has any note left replaces the bridge's stored list; else what is stored stays.
    """
    notes = given.select("bridge_id", F.trim("collection_key").alias("collection_key"), F.trim(F.coalesce("why", F.lit(""))).alias("why"), "position")
    known = notes.join(valid.select("bridge_id", "collection_key").distinct(), ["bridge_id", "collection_key"], "left_semi")
    first = known.groupBy("bridge_id", "collection_key").agg(F.min_by("why", "position").alias("why"), F.min("position").alias("position"))
    kept = stored.join(first.select("bridge_id").distinct(), "bridge_id", "left_anti")
    return first.unionByName(kept.select(*first.columns))
