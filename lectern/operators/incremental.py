"""Incremental work: stamps, watermarks, keyed upserts and change plans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stale_rows(current: DataFrame, stored: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Current rows with no stored stamp or with a differing compared field."""
    kept = stored.select(key, *[F.col(f).alias(f"_old_{f}") for f in fields], F.lit(True).alias("_known"))
    differs = reduce(lambda a, b: a | b, (~F.col(f).eqNullSafe(F.col(f"_old_{f}")) for f in fields))
    joined = current.join(kept, key, "left")
    return joined.where(F.col("_known").isNull() | differs).select(current.columns)


def pending(rows: DataFrame, ingested: DataFrame, key: str, since: Column | None) -> DataFrame:
    """Rows ingested after the last run; an unknown time counts as pending."""
    if since is None:
        return rows
    seen = ingested.where(F.col("ingested_at").isNotNull() & (F.col("ingested_at") <= since)).select(key)
    return rows.join(seen, key, "left_anti")


def last_wins(rows: DataFrame, key: str, position: str) -> DataFrame:
    """One row per key: the one written last."""
    return _one_per_key(rows, key, F.max_by, position)


def first_wins(rows: DataFrame, key: str, position: str) -> DataFrame:
    """One row per key: the one written first."""
    return _one_per_key(rows, key, F.min_by, position)


def _one_per_key(rows: DataFrame, key: str, pick, position: str) -> DataFrame:
    rest = [c for c in rows.columns if c != key]
    chosen = rows.groupBy(key).agg(pick(F.struct(*rest), F.col(position)).alias("_row"))
    return chosen.select(key, *[F.col(f"_row.{c}").alias(c) for c in rest])


def change_plan(manifest: DataFrame, snapshot: DataFrame, ignored: DataFrame) -> DataFrame:
    """Actions that bring the manifest in line with a live snapshot.

    Both sides carry path, file_hash and material_id (unique by path). Ignored
    hashes are skipped and do not count as live. An id that a new path took
    over in the same batch is not deleted.
    """
    live = snapshot.join(ignored, "file_hash", "left_anti")
    old = manifest.select("path", F.col("file_hash").alias("old_hash"), F.col("material_id").alias("old_id"))
    diff = live.join(old, "path", "full_outer")
    is_live, is_known = F.col("material_id").isNotNull(), F.col("old_id").isNotNull()
    changed = is_live & is_known & ((F.col("file_hash") != F.col("old_hash")) | (F.col("material_id") != F.col("old_id")))

    updated = diff.where(changed).select(F.lit("update").alias("action"), "path", "material_id")
    hashes = manifest.groupBy("file_hash").agg(F.max("material_id").alias("hash_id"))
    fresh = diff.where(is_live & ~is_known).select("path", "file_hash", "material_id").join(hashes, "file_hash", "left")
    arrived = fresh.select(
        F.when(F.col("hash_id").isNotNull(), "move").otherwise("add").alias("action"), "path",
        F.coalesce("hash_id", "material_id").alias("material_id"))
    gone = diff.where(changed | (is_known & ~is_live)).select(F.col("old_id").alias("material_id")).distinct()
    deleted = gone.join(arrived, "material_id", "left_anti").select(
        F.lit("delete").alias("action"), F.lit("").alias("path"), "material_id")
    return updated.unionByName(arrived).unionByName(deleted)


def cascade_delete(memberships: DataFrame, removed: DataFrame) -> DataFrame:
    """Memberships left after removing materials.

    A cluster left with fewer than two distinct materials collapses: its
    smallest and largest material are then the same.
    """
    left = memberships.join(removed.select("material_id"), "material_id", "left_anti")
    alive = left.groupBy("cluster_id").agg(F.min("material_id").alias("_a"), F.max("material_id").alias("_b")).where("_a != _b")
    return left.join(alive, "cluster_id", "left_semi")


def index_gate(stamp: DataFrame, manifest_rows: Column, newest_input: Column, digest: Column) -> DataFrame:
    """One row saying whether the index must be rebuilt, and why.

    Checks run cheapest first: no stamp, other row count, and only when some
    input is newer than the stamp, the content digest.
    """
    reason = (
        F.when(F.col("indexed_at").isNull(), "no stamp")
        .when(F.col("materials") != manifest_rows, "material count differs")
        .when((newest_input > F.col("indexed_at")) & (F.col("digest") != digest), "content changed")
        .otherwise("")
    )
    return stamp.select(reason.alias("reason"), (reason != "").alias("stale"))


def later_map_wins(stamps: DataFrame, key: str, value: str, position: str) -> DataFrame:
    """Union of key→value stamps: the later one wins, empty values are dropped."""
    usable = stamps.where((F.coalesce(F.col(key).cast("string"), F.lit("")) != "") & (F.coalesce(value, F.lit("")) != ""))
    return usable.groupBy(key).agg(F.max_by(value, position).alias(value))
