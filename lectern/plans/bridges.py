"""Bridge inputs, reflections that are due, and merged reflections."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions.lists import canonical_hash
from lectern.operators import bridges as ops
from lectern.plans import corpus
from lectern.plans.corpus import CLUSTERS, table, with_ctes
from lectern.plans.registry import query

SNAPSHOTS = """
snaps AS (
  SELECT cluster_id, canonical_name, domain, collection,
    substr(sha256(CAST(to_json({'p0': CAST(cluster_id AS VARCHAR), 'p1': canonical_name, 'p2': domain, 'p3': collection}) AS VARCHAR)), 1, 16) AS fingerprint,
    substr(sha256(CAST(to_json({'p0': CAST(cluster_id AS VARCHAR), 'p1': CASE WHEN weight < 0 THEN 'old name' ELSE canonical_name END, 'p2': domain, 'p3': collection}) AS VARCHAR)), 1, 16) AS before,
    weight, bridge_id FROM clusters),
held AS (SELECT cluster_id, domain FROM snaps WHERE bridge_id % 3 <> 0 AND domain <> 'asia')"""


@query("bridge_inputs", "G9 H7", with_ctes(CLUSTERS, SNAPSHOTS) + """
SELECT * FROM (
  SELECT cluster_id, canonical_name, domain, collection, fingerprint, CASE WHEN domain NOT IN (SELECT domain FROM held) THEN 'no bridges yet'
    WHEN weight > 9000 OR before <> fingerprint THEN 'changed' WHEN cluster_id NOT IN (SELECT cluster_id FROM held) THEN 'in no bridge' END AS reason FROM snaps)
WHERE reason IS NOT NULL""")
def bridge_inputs(spark, folder):
    """Clusters to bridge, by comparing snapshot fingerprints with the last run's (absent for the richest ones)."""
    rows = corpus.clusters(spark, folder)
    shown = rows.select("cluster_id", "canonical_name", "domain", "collection")
    name = F.when(F.col("weight") < 0, "old name").otherwise(F.col("canonical_name"))
    previous = rows.where("weight <= 9000").select("cluster_id", canonical_hash(
        F.col("cluster_id"), name, F.col("domain"), F.col("collection")).alias("fingerprint"))
    held = rows.where("bridge_id % 3 != 0 AND domain != 'asia'").select("cluster_id", "domain")
    return ops.pending_inputs(shown, previous, held)


OLD = """
old AS (
  SELECT p_partkey AS bridge_id, p_name AS canonical_name, p_type AS descriptor, CASE WHEN p_size % 7 = 0 THEN ' ' ELSE p_brand END AS why,
    [p_brand] AS aliases, [p_type, p_name] AS takeaways FROM part),
given AS (
  SELECT p_partkey AS bridge_id, CASE WHEN p_size % 2 = 0 THEN '  ' ELSE upper(p_name) END AS canonical_name, 'about ' || p_type AS descriptor,
    CASE WHEN p_size % 5 = 0 THEN '' ELSE p_name END AS why,
    CASE WHEN p_size % 4 = 0 THEN ['', ' '] ELSE [' A' || (p_size % 3), 'a' || (p_size % 3), 'b', 'c', 'd', 'e', 'f', 'g', 'h', 'i'] END AS aliases,
    CASE WHEN p_size % 3 = 0 THEN CAST(NULL AS VARCHAR[]) ELSE ['t1', 'T1 ', 't2', 't3', 't4', 't5', 't6', 't7'] END AS takeaways
  FROM part WHERE p_partkey % 3 = 0)"""


def _old(spark, folder):
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("bridge_id"), F.col("p_name").alias("canonical_name"), F.col("p_type").alias("descriptor"),
        F.when(F.col("p_size") % 7 == 0, " ").otherwise(F.col("p_brand")).alias("why"), F.array("p_brand").alias("aliases"),
        F.array("p_type", "p_name").alias("takeaways"), *[F.array().cast("array<string>").alias(n) for n in ("tensions", "open_questions", "new_sources")])


@query("bridge_reflections_merged", "G20 H30", with_ctes(OLD) + """
SELECT o.bridge_id, coalesce(nullif(trim(g.canonical_name), ''), o.canonical_name) AS canonical_name, coalesce(nullif(trim(g.descriptor), ''), o.descriptor) AS descriptor,
  coalesce(nullif(trim(g.why), ''), o.why) AS why,
  array_to_string(CASE WHEN g.aliases IS NULL OR g.aliases[1] = '' THEN o.aliases ELSE [trim(g.aliases[1]), 'b', 'c', 'd', 'e', 'f', 'g', 'h'] END, '|') AS aliases,
  array_to_string(CASE WHEN g.takeaways IS NULL THEN o.takeaways ELSE ['t1', 't2', 't3', 't4', 't5', 't6'] END, '|') AS takeaways
FROM old o LEFT JOIN given g USING (bridge_id)""")
def bridge_reflections_merged(spark, folder):
    """Reflections merged into bridges: blanks and nulls keep what is stored, lists are cleaned and cut."""
    size = F.col("p_size")
    cased = F.array(F.concat(F.lit(" A"), (size % 3).cast("string")), F.concat(F.lit("a"), (size % 3).cast("string")), *map(F.lit, "bcdefghi"))
    given = table(spark, folder, "part").where("p_partkey % 3 = 0").select(
        F.col("p_partkey").alias("bridge_id"), F.when(size % 2 == 0, "  ").otherwise(F.upper("p_name")).alias("canonical_name"),
        F.concat(F.lit("about "), "p_type").alias("descriptor"), F.when(size % 5 == 0, "").otherwise(F.col("p_name")).alias("why"),
        F.when(size % 4 == 0, F.array(F.lit(""), F.lit(" "))).otherwise(cased).alias("aliases"),
        F.when(size % 3 != 0, F.array(*map(F.lit, ("t1", "T1 ", "t2", "t3", "t4", "t5", "t6", "t7")))).alias("takeaways"),
        *[F.lit(None).cast("array<string>").alias(n) for n in ("tensions", "open_questions", "new_sources")])
    merged = ops.reflected(_old(spark, folder), given)
    return merged.select("bridge_id", "canonical_name", "descriptor", "why", F.array_join("aliases", "|").alias("aliases"), F.array_join("takeaways", "|").alias("takeaways"))


@query("bridge_reflections_due", "H31", with_ctes(OLD) + """,
s AS (SELECT bridge_id, why, substr(sha256(CAST(to_json({'p0': canonical_name, 'p1': descriptor}) AS VARCHAR)), 1, 16) AS fingerprint FROM old),
changed AS (SELECT DISTINCT l_partkey AS bridge_id FROM lineitem WHERE l_quantity > 49)
SELECT * FROM (
  SELECT s.bridge_id, CASE WHEN s.bridge_id IN (SELECT bridge_id FROM changed) THEN 'changed' WHEN trim(why) = '' THEN 'no prose'
    WHEN p_size > 40 OR p_size % 11 = 0 THEN 'stale stamp' END AS reason FROM s JOIN part ON p_partkey = s.bridge_id)
WHERE reason IS NOT NULL""")
def bridge_reflections_due(spark, folder):
    """Bridges whose members changed, that have no prose, or whose stamp is missing or another fingerprint's."""
    old = _old(spark, folder)
    fingerprint = canonical_hash(F.col("canonical_name"), F.col("descriptor"))
    stamps = table(spark, folder, "part").where("p_size <= 40").select(
        F.col("p_partkey").alias("bridge_id"), canonical_hash(F.col("p_name"), F.when(F.col("p_size") % 11 == 0, "old").otherwise(F.col("p_type"))).alias("stamp"))
    bridges = old.select("bridge_id", "why", fingerprint.alias("fingerprint")).join(stamps, "bridge_id", "left")
    changed = table(spark, folder, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("bridge_id"))
    return ops.reflections_due(bridges, changed)


@query("bridge_collection_notes", "H30 H34", """
WITH scopes AS (SELECT DISTINCT p_size AS bridge_id, p_brand AS collection_key FROM part WHERE p_brand <> 'Brand#2'),
given AS (
  SELECT p_size AS bridge_id, trim(CASE WHEN p_partkey % 7 = 0 THEN 'nowhere' ELSE ' ' || p_brand END) AS collection_key,
    trim(CASE WHEN p_partkey % 3 = 0 THEN ' ' ELSE 'new ' || p_name END) AS why, p_partkey AS position FROM part WHERE p_size % 4 <> 0),
valid AS (
  SELECT g.* FROM given g SEMI JOIN scopes s ON s.bridge_id = g.bridge_id AND s.collection_key = g.collection_key
  QUALIFY row_number() OVER (PARTITION BY g.bridge_id, g.collection_key ORDER BY position) = 1)
SELECT bridge_id, collection_key, why, CAST(position AS BIGINT) AS position FROM valid
UNION ALL
SELECT s.bridge_id, s.collection_key, 'stored ' || s.collection_key, CAST(0 AS BIGINT) FROM scopes s WHERE s.bridge_id NOT IN (SELECT bridge_id FROM valid)""")
def bridge_collection_notes(spark, folder):
    """Why a collection matters to a bridge: only its own collections, the first note of each, else what is stored."""
    part = table(spark, folder, "part")
    scopes = part.where("p_brand <> 'Brand#2'").select(F.col("p_size").alias("bridge_id"), F.col("p_brand").alias("collection_key")).distinct()
    stored = scopes.select("bridge_id", "collection_key", F.concat(F.lit("stored "), "collection_key").alias("why"), F.lit(0).cast("long").alias("position"))
    number = F.col("p_partkey")
    given = part.where("p_size % 4 <> 0").select(
        F.col("p_size").alias("bridge_id"), F.when(number % 7 == 0, "nowhere").otherwise(F.concat(F.lit(" "), "p_brand")).alias("collection_key"),
        F.when(number % 3 == 0, " ").otherwise(F.concat(F.lit("new "), "p_name")).alias("why"), number.cast("long").alias("position"))
    return ops.collection_notes(stored, given, scopes)
