"""Audits of clusters: proposals that contest each other's claims, and reviews."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions.fixed import REVIEW_BACKFILL
from lectern.operators import audit as ops
from lectern.plans.corpus import table
from lectern.plans.registry import query

CLAIMS = """
d AS (
  SELECT DISTINCT l_suppkey AS scope, l_orderkey // 400 AS proposal, l_partkey % 40 AS material_id, l_linenumber % 3 AS concept_key,
    FALSE AS retained FROM lineitem WHERE l_returnflag <> 'N' OR l_orderkey % 3 = 0
  UNION SELECT DISTINCT l_suppkey, l_orderkey // 400, 1000 + l_partkey % 7, 0, TRUE FROM lineitem WHERE l_returnflag = 'N' AND l_quantity > 47)"""

DECIDED = f"""
WITH RECURSIVE {CLAIMS},
p AS (
  SELECT scope, proposal, row_number() OVER (PARTITION BY scope ORDER BY proposal) AS rn,
    coalesce(list_distinct(list([material_id, concept_key]) FILTER (NOT retained)), CAST([] AS BIGINT[][])) AS asked,
    coalesce(list_distinct(list(material_id) FILTER (retained)), CAST([] AS BIGINT[])) AS kept FROM d GROUP BY 1, 2),
fold AS (
  SELECT DISTINCT scope, CAST(-1 AS BIGINT) AS proposal, CAST(0 AS BIGINT) AS rn, FALSE AS accepted, CAST(0 AS BIGINT) AS claims,
    CAST(0 AS BIGINT) AS materials, CAST([] AS BIGINT[][]) AS held FROM p
  UNION ALL
  SELECT scope, proposal, rn, n >= 2, CASE WHEN n >= 2 THEN CAST(len(won) + len(kept) AS BIGINT) ELSE 0 END, CASE WHEN n >= 2 THEN n ELSE 0 END,
    CASE WHEN n >= 2 THEN list_concat(held, won) ELSE held END
  FROM (
    SELECT *, CAST(len(list_distinct(list_concat(list_transform(won, lambda x: x[1]), kept))) AS BIGINT) AS n FROM (
      SELECT p.scope, p.proposal, p.rn, p.kept, f.held, list_filter(p.asked, lambda x: NOT list_contains(f.held, x)) AS won
      FROM fold f JOIN p ON p.scope = f.scope AND p.rn = f.rn + 1)))"""


@query("audit_proposals_decided", "G6 H19 W13", DECIDED + """
SELECT scope, proposal, accepted, claims, materials FROM fold WHERE rn > 0""")
def audit_proposals_decided(spark, folder):
    """Proposals in order: what an accepted one holds no later one gets, a refused one gives its claims back."""
    items = table(spark, folder, "lineitem")
    number = F.floor(F.col("l_orderkey") / 400).alias("proposal")
    asked = items.where("l_returnflag <> 'N' OR l_orderkey % 3 = 0").select(
        F.col("l_suppkey").alias("scope"), number, (F.col("l_partkey") % 40).alias("material_id"),
        (F.col("l_linenumber") % 3).alias("concept_key"), F.lit(False).alias("retained"))
    kept = items.where("l_returnflag = 'N' AND l_quantity > 47").select(
        F.col("l_suppkey"), number, 1000 + F.col("l_partkey") % 7, F.lit(0), F.lit(True))
    decided, held = ops.accepted(asked.union(kept))
    counts = held.groupBy("scope", "proposal", "material_id").agg(F.count("*").alias("n")).groupBy("scope", "proposal").agg(
        F.sum("n").alias("claims"), F.count("*").alias("materials"))
    return decided.join(counts, ["scope", "proposal"], "left").select(
        "scope", "proposal", "accepted", F.coalesce("claims", F.lit(0)).alias("claims"), F.coalesce("materials", F.lit(0)).alias("materials"))


REVIEWS = """
clusters AS (SELECT 'c' || c_custkey AS cluster_id FROM customer),
fields AS (
  SELECT o_orderkey AS position, 'c' || o_custkey AS cluster_id, CASE WHEN o_orderkey % 8 = 7 THEN NULL ELSE o_orderdate END AS run_at, o_orderkey % 4 AS part,
    CASE WHEN o_orderkey % 17 = 0 THEN ' ' ELSE 'drift' END AS finding_type,
    ['High', 'medium', ' low', 'urgent'][1 + o_orderkey % 3 + CASE WHEN o_orderkey % 31 = 0 THEN 3 - o_orderkey % 3 ELSE 0 END] AS severity,
    ['open', 'Resolved', 'improved', 'validated', 'gone'][1 + o_orderkey % 4 + CASE WHEN o_orderkey % 29 = 0 THEN 4 - o_orderkey % 4 ELSE 0 END] AS status,
    CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE ' note ' || o_orderkey END AS note, CASE WHEN o_orderkey % 19 = 0 THEN '' ELSE 'do' END AS recommendation FROM orders),
f AS (
  SELECT position, CASE WHEN part = 1 AND position % 7 = 0 THEN 'x' || position WHEN part = 2 AND position % 13 = 0 THEN '' ELSE cluster_id END AS cluster_id, run_at, part,
    trim(finding_type) AS finding_type, lower(trim(severity)) AS severity,
    CASE lower(status) WHEN 'resolved' THEN 'validated' WHEN 'improved' THEN 'open' ELSE lower(status) END AS status, trim(coalesce(note, '')) AS note, recommendation FROM fields),
stored AS (
  SELECT * FROM f WHERE part = 0 AND cluster_id IN (SELECT cluster_id FROM clusters)
  QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY run_at DESC NULLS LAST, position DESC) = 1),
given AS (
  SELECT f.*, CASE WHEN f.part = 3 THEN 'update' ELSE 'new' END AS kind, s.cluster_id IS NOT NULL AS reviewed, c.cluster_id IS NOT NULL AS known
  FROM f LEFT JOIN stored s ON s.cluster_id = f.cluster_id LEFT JOIN clusters c ON c.cluster_id = f.cluster_id WHERE f.part > 0),
judged AS (
  SELECT *, CASE WHEN cluster_id = '' THEN 'missing cluster_id' WHEN kind = 'new' AND NOT known THEN 'unknown cluster ' || cluster_id
      WHEN kind = 'new' AND reviewed THEN 'has a review, use an update' WHEN kind = 'update' AND NOT reviewed THEN 'has no review, use a new one' END AS early,
    CASE WHEN finding_type = '' THEN 'missing finding_type' WHEN severity NOT IN ('high', 'medium', 'low') THEN 'invalid severity ' || severity
      WHEN status NOT IN ('open', 'validated') THEN 'invalid status ' || status WHEN note = '' THEN 'missing note' WHEN recommendation = '' THEN 'missing recommendation' END AS fault FROM given),
chosen AS (SELECT * FROM judged WHERE early IS NULL AND fault IS NULL QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY position) = 1)"""


def _reviews(spark, folder):
    o, key = table(spark, folder, "orders"), F.col("o_orderkey")
    part = key % 4
    pick = lambda names, at: F.get(F.array(*map(F.lit, names)), at.cast("int"))
    rows = o.select(
        key.alias("position"), F.when((part == 1) & (key % 7 == 0), F.concat(F.lit("x"), key.cast("string"))).when(
            (part == 2) & (key % 13 == 0), "").otherwise(F.concat(F.lit("c"), F.col("o_custkey").cast("string"))).alias("cluster_id"),
        F.when(key % 8 != 7, F.col("o_orderdate")).alias("run_at"), part.alias("part"),
        F.when(key % 17 == 0, " ").otherwise("drift").alias("finding_type"),
        F.when(key % 31 == 0, "urgent").otherwise(pick(("High", "medium", " low"), key % 3)).alias("severity"),
        F.when(key % 29 == 0, "gone").otherwise(pick(("open", "Resolved", "improved", "validated"), part)).alias("status"),
        F.when(key % 23 != 0, F.concat(F.lit(" note "), key.cast("string"))).alias("note"), F.when(key % 19 == 0, "").otherwise("do").alias("recommendation"))
    clusters = table(spark, folder, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("cluster_id"))
    return ops.merged_reviews(rows.where("part = 0"), rows.where("part = 3"), rows.where("part in (1, 2)"), clusters)


@query("audit_reviews_merged", "G8 U9 W10", "WITH " + REVIEWS + f""",
merged AS (SELECT cluster_id, finding_type, severity, status, note, recommendation FROM chosen
  UNION ALL SELECT cluster_id, finding_type, severity, status, note, recommendation FROM stored WHERE cluster_id NOT IN (SELECT cluster_id FROM chosen))
SELECT * FROM merged
UNION ALL SELECT cluster_id, {", ".join("'" + v + "'" for v in REVIEW_BACKFILL)} FROM clusters WHERE cluster_id NOT IN (SELECT cluster_id FROM merged)""")
def audit_reviews_merged(spark, folder):
    """One review per cluster: the latest stored one, an update or a new one, else that it was validated."""
    return _reviews(spark, folder)[0]


@query("audit_review_errors", "G8", "WITH " + REVIEWS + """
SELECT * FROM (
  SELECT j.kind, j.position, coalesce(early, CASE WHEN j.position > c.position THEN 'duplicate cluster_id' END, fault) AS error
  FROM judged j LEFT JOIN (SELECT cluster_id, position FROM chosen) c ON c.cluster_id = j.cluster_id) WHERE error IS NOT NULL""")
def audit_review_errors(spark, folder):
    """Reviews that were refused, with the first reason that holds."""
    return _reviews(spark, folder)[1]
