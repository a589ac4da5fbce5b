"""Merging proposed changes into the concept graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions.names import cluster_name_key
from lectern.functions.text import bind, strip


def _prefixes(key: Column) -> Column:
    lengths = F.sequence(F.lit(0), F.length(key))
    return F.transform(lengths, lambda n: F.substring(key, F.lit(1), n))


def _marked(mark: str, tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.concat(F.lit(mark), t))


def resolve_references(refs: DataFrame, index: DataFrame) -> DataFrame:
    """Attach the indexed concept key to each (material, name) reference.

    Exact key first, then a unique caseless name, then a unique key that is a
    prefix of the other; what stays ambiguous is dropped. All three tests are
    one equality join on (material, probe), where a probe is a test's digit and
    a text, and a prefix test is equality with a generated prefix; no
    material's concepts are paired with each other. ``index`` is unique per
    (material_id, concept_key).
    """
    name = F.lower(strip(F.col("concept_name")))

    def asked_probes(key: Column) -> Column:
        return F.concat(
            F.array(F.concat(F.lit("0"), key)), F.array(F.concat(F.lit("1"), name)),
            F.array(F.concat(F.lit("3"), key)), _marked("2", _prefixes(key)))

    known_key = F.col("concept_key")
    known_probes = F.concat(
        F.array(F.concat(F.lit("0"), known_key)), F.array(F.concat(F.lit("1"), name)),
        F.array(F.concat(F.lit("2"), known_key)), _marked("3", _prefixes(known_key)))
    asked = refs.select("ref_id", "material_id", F.explode(
        bind(cluster_name_key(F.col("concept_name")), asked_probes)).alias("probe"))
    known = index.select("material_id", "concept_key", F.explode(known_probes).alias("probe"))
    # merged: the size check sees the concepts before each of them becomes some 15 probes, and would broadcast them
    pairs = asked.join(known.hint("merge"), ["material_id", "probe"]).select(
        "ref_id", F.least(F.substring("probe", 1, 1), F.lit("2")).alias("stage"), "concept_key").distinct()
    at = [F.when(F.col("stage") == str(s), F.col("concept_key")) for s in range(3)]
    counted = pairs.groupBy("ref_id").agg(
        *[F.count(at[s]).alias(f"n{s}") for s in range(3)], *[F.min(at[s]).alias(f"k{s}") for s in range(3)])
    choice = F.coalesce(*[F.when(F.col(f"n{s}") == 1, F.col(f"k{s}")) for s in range(3)])
    return counted.select("ref_id", choice.alias("concept_key")).where("concept_key IS NOT NULL")


def first_claims(resolved: DataFrame) -> DataFrame:
    """Each (material, concept) goes to the first cluster that names it."""
    return resolved.groupBy("material_id", "concept_key").agg(
        F.min_by(F.struct("cluster_id", "src_pos"), F.struct("cluster_pos", "src_pos")).alias("_c")
    ).select("material_id", "concept_key", "_c.cluster_id", "_c.src_pos")


def connected(claims: DataFrame) -> DataFrame:
    """Claims of clusters that reach two distinct materials.

    Runs after claiming: a dropped cluster keeps what it claimed. Two distinct
    materials exist exactly when smallest and largest differ.
    """
    spread = claims.groupBy("cluster_id").agg(F.min("material_id").alias("_a"), F.max("material_id").alias("_b"))
    return claims.join(spread.where("_a != _b").select("cluster_id"), "cluster_id", "left_semi")


def running_number(rows: DataFrame, groups: list[str], position: str, width: int = 1_000_000,
                   name: str = "number") -> DataFrame:
    """1, 2, 3, … by position within a group, also when one group is huge.

    A group's rows are numbered inside fixed-width position ranges; the counts
    of earlier ranges (one row per range) are then added. No task sees more
    than one range of a group.
    """
    bucketed = rows.withColumn("_bucket", F.floor(F.col(position) / width))
    inside = Window.partitionBy(*groups, "_bucket").orderBy(position)
    counts = bucketed.groupBy(*groups, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*groups, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    numbered = bucketed.withColumn("_r", F.row_number().over(inside)).join(offsets, [*groups, "_bucket"])
    return numbered.withColumn(name, (F.col("_r") + F.col("_offset")).cast("bigint")).drop("_bucket", "_r", "_offset")


def eligible_bridges(members: DataFrame) -> DataFrame:
    """Bridges of one domain with two members over two collections, else three.

    ``members`` is distinct per (bridge, cluster). "One domain" and "several
    collections" are min/max comparisons, so no distinct count is needed.
    """
    grouped = members.groupBy("bridge_id").agg(
        F.count(F.lit(1)).alias("members"),
        F.min("domain").alias("domain"), F.max("domain").alias("_dmax"),
        F.min("collection").alias("_cmin"), F.max("collection").alias("_cmax"))
    several = F.col("_cmin") != F.col("_cmax")
    need = F.when(several, 2).otherwise(3)
    return grouped.where((F.col("domain") == F.col("_dmax")) & (F.col("members") >= need)).select(
        "bridge_id", "domain", "members", several.alias("several_collections"))


def latest_per(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row per key by the given columns, later ones winning ties."""
    rest = [c for c in rows.columns if c != key]
    picked = rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(key, *[F.col(f"_row.{c}").alias(c) for c in rest])


def keep_unless_given(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Merge proposals: a null field keeps the stored value."""
    proposed = new.select(key, *[F.col(f).alias(f"_new_{f}") for f in fields])
    merged = old.join(proposed, key, "full_outer")
    return merged.select(key, *[F.coalesce(f"_new_{f}", f).alias(f) for f in fields])


def audit_targets(clusters: DataFrame, reviews: DataFrame) -> DataFrame:
    """Clusters without review or changed since; an open review adds a reason."""
    seen = reviews.select("cluster_id", F.col("input_fingerprint").alias("_old"), "status", F.lit(True).alias("_seen"))
    joined = clusters.join(seen, "cluster_id", "left")
    missing = F.col("_seen").isNull()
    changed = ~missing & ~F.col("_old").eqNullSafe(F.col("fingerprint"))
    reasons = F.array_compact(F.array(
        F.when(missing, F.lit("missing_review")),
        F.when(changed, F.lit("changed_since_last_audit")),
        F.when(changed & (F.lower("status") == "open"), F.lit("open_review"))))
    return joined.where(missing | changed).select("cluster_id", F.array_join(reasons, ",").alias("reasons"))


def cluster_id(scope: Column, number: Column) -> Column:
    """Id of a scope's cluster: the number has seven digits at least and is never cut."""
    return F.concat(scope, F.lit("__local_"), F.format_string("%07d", number))


def normalized_references(references: Column) -> Column:
    """Array of (material_id, concept_name): trimmed, without blanks, the first of each material and folded name."""
    kind = F.transform(references, lambda r: F.struct(
        F.trim(F.coalesce(r["material_id"], F.lit(""))).alias("material_id"),
        F.trim(F.coalesce(r["concept_name"], F.lit(""))).alias("concept_name")))
    filled = F.filter(kind, lambda r: (r["material_id"] != "") & (r["concept_name"] != ""))

    def firsts(items: Column) -> Column:
        keys = F.transform(items, lambda r: F.struct(r["material_id"], F.lower(r["concept_name"])))
        return bind(keys, lambda k: F.filter(items, lambda r, i: F.array_position(k, F.get(k, i)) == i + 1))

    return bind(filled, firsts)


def delta_parts(parts: DataFrame, known: DataFrame) -> DataFrame:
    """Parts of a proposed cluster delta with normalised references, and why a part is skipped (empty: it is not).

    parts: part_id, kind (link or new), cluster_id, canonical_name, refs. known: cluster_id.
    """
    rows = parts.withColumn("refs", normalized_references(F.col("refs"))).join(
        known.select("cluster_id", F.lit(True).alias("_known")), "cluster_id", "left")
    link, cluster = F.col("kind") == "link", F.trim(F.coalesce("cluster_id", F.lit("")))
    reason = (
        F.when(link & (cluster == ""), "cluster_id is missing")
        .when(link & F.col("_known").isNull(), "cluster_id is unknown")
        .when(~link & (F.trim(F.coalesce("canonical_name", F.lit(""))) == ""), "canonical_name is missing")
        .when(F.size("refs") == 0, "no valid source_concepts").otherwise(""))
    return rows.select("part_id", "kind", "cluster_id", "canonical_name", "refs", reason.alias("reason"))


def first_spellings(names: DataFrame, key: str) -> DataFrame:
    """(key, alias, position) -> the first spelling of each folded alias of a key, numbered in order."""
    kept = names.select(key, F.trim("alias").alias("alias"), "position").where("alias != ''").groupBy(
        key, F.lower("alias").alias("_folded")).agg(F.min_by("alias", "position").alias("alias"), F.min("position").alias("position"))
    return kept.drop("_folded")
