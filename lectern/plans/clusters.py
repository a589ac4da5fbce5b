"""Cluster deltas: parts with reasons, canonical records and their aliases."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions.names import slugify
from lectern.operators import deltas as ops
from lectern.plans import corpus
from lectern.plans.corpus import CONCEPTS, table, with_ctes
from lectern.plans.deltas import CLAIMS, REFS, _claims, _concepts
from lectern.plans.registry import query

PARTS = r"""
parts AS (
  SELECT event_id AS part_id, CASE WHEN event_type IN ('view', 'click') THEN 'link' ELSE 'new' END AS kind,
    CASE event_id % 11 WHEN 0 THEN '' ELSE 'c' || (event_id % 150) END AS cluster_id,
    CASE WHEN event_id % 7 = 0 THEN '  ' ELSE 'Name ' || (event_id % 20) END AS canonical_name,
    CASE WHEN event_id % 9 = 0 THEN [{'m': CAST(user_id AS VARCHAR), 'n': ' '}, {'m': '', 'n': 'x'}]
      ELSE [{'m': CAST(user_id AS VARCHAR), 'n': ' Term ' || (event_id % 6)}, {'m': CAST(user_id AS VARCHAR), 'n': 'TERM ' || (event_id % 6)},
            {'m': ' ' || (user_id + event_id % 2), 'n': 'term ' || (event_id % 6)}, {'m': 'z', 'n': ''}] END AS refs FROM events),
known AS (SELECT 'c' || s_suppkey AS cluster_id FROM supplier),
cleaned AS (
  SELECT p.*, list_filter(list_transform(refs, lambda r: {'m': trim(r.m), 'n': trim(r.n)}), lambda r: r.m <> '' AND r.n <> '') AS l FROM parts p),
keyed_parts AS (SELECT *, list_transform(l, lambda r: r.m || chr(31) || lower(r.n)) AS k FROM cleaned),
checked AS (
  SELECT part_id, kind, c.cluster_id, canonical_name, list_filter(l, lambda r, i: list_position(k, k[i]) = i) AS refs,
    CASE WHEN kind = 'link' AND c.cluster_id = '' THEN 'cluster_id is missing' WHEN kind = 'link' AND known.cluster_id IS NULL THEN 'cluster_id is unknown'
      WHEN kind = 'new' AND trim(canonical_name) = '' THEN 'canonical_name is missing' WHEN len(l) = 0 THEN 'no valid source_concepts' ELSE '' END AS reason
  FROM keyed_parts c LEFT JOIN known ON known.cluster_id = c.cluster_id)"""


def _parts(spark, folder):
    e, user = F.col("event_id"), F.col("user_id").cast("string")

    def ref(material, name):
        return F.struct(material.alias("material_id"), name.alias("concept_name"))

    term = (e % 6).cast("string")
    blank = F.array(ref(user, F.lit(" ")), ref(F.lit(""), F.lit("x")))
    full = F.array(
        ref(user, F.concat(F.lit(" Term "), term)), ref(user, F.concat(F.lit("TERM "), term)),
        ref(F.concat(F.lit(" "), (F.col("user_id") + e % 2).cast("string")), F.concat(F.lit("term "), term)), ref(F.lit("z"), F.lit("")))
    parts = table(spark, folder, "events").select(
        e.alias("part_id"), F.when(F.col("event_type").isin("view", "click"), "link").otherwise("new").alias("kind"),
        F.when(e % 11 == 0, "").otherwise(F.concat(F.lit("c"), (e % 150).cast("string"))).alias("cluster_id"),
        F.when(e % 7 == 0, "  ").otherwise(F.concat(F.lit("Name "), (e % 20).cast("string"))).alias("canonical_name"),
        F.when(e % 9 == 0, blank).otherwise(full).alias("refs"))
    known = table(spark, folder, "supplier").select(F.concat(F.lit("c"), F.col("s_suppkey").cast("string")).alias("cluster_id"))
    return ops.delta_parts(parts, known)


@query("cluster_delta_parts", "G3 G10 H5", with_ctes(PARTS) + """
SELECT part_id, kind, cluster_id, reason, len(refs) AS refs FROM checked""")
def cluster_delta_parts(spark, folder):
    """Each link and each new cluster of a delta, with its distinct references and the reason it is skipped for."""
    return _parts(spark, folder).select("part_id", "kind", "cluster_id", "reason", F.size("refs").cast("bigint").alias("refs"))


@query("cluster_delta_links", "G3 H5", with_ctes(PARTS) + """
SELECT cluster_id, r.m AS material_id, min(r.n) AS concept_name, count(*) AS named
FROM (SELECT cluster_id, unnest(refs) AS r FROM checked WHERE kind = 'link' AND reason = '') GROUP BY cluster_id, r.m, lower(r.n)""")
def cluster_delta_links(spark, folder):
    """References that accepted links add to existing clusters, one per material and folded name."""
    links = _parts(spark, folder).where("kind = 'link' AND reason = ''").select("cluster_id", F.inline("refs"))
    return links.groupBy("cluster_id", "material_id", F.lower("concept_name").alias("f")).agg(
        F.min("concept_name").alias("concept_name"), F.count(F.lit(1)).alias("named")).drop("f")


RECORDS = with_ctes(CONCEPTS, REFS) + CLAIMS + r""",
sources AS (SELECT k.cluster_id, CAST(substr(k.cluster_id, 4) AS BIGINT) AS place, material_id, concept_key, concept_name, relevance, pos
  FROM kept k JOIN concepts USING (material_id, concept_key)),
titled AS (
  SELECT cluster_id, place, CASE WHEN place % 4 = 0 THEN 'Theme ' || place ELSE arg_min(concept_name, {'a': pos, 'b': material_id, 'c': concept_key}) END AS canonical_name,
    count(DISTINCT material_id) AS materials,
    round(greatest(0.0, least(1.0, avg(CASE relevance WHEN 'high' THEN 1.0 WHEN 'medium' THEN 0.7 ELSE 0.4 END))), 6) AS confidence
  FROM sources GROUP BY 1, 2)"""


def _sources(spark, folder):
    concepts = _concepts(spark, folder)
    kept = ops.connected(_claims(spark, folder, concepts)).select("cluster_id", "material_id", "concept_key")
    named = concepts.select("material_id", "concept_key", "concept_name", "relevance", "pos")
    return kept.join(named, ["material_id", "concept_key"]).withColumn("place", F.substring("cluster_id", 4, 19).cast("bigint"))


def _canonical(sources):
    first = F.min_by("concept_name", F.struct("pos", "material_id", "concept_key"))
    return F.when(F.col("place") % 4 == 0, F.concat(F.lit("Theme "), F.col("place").cast("string"))).otherwise(first)


@query("cluster_records", "G4 G5", RECORDS + """
SELECT format('bridge_{:04d}', row_number() OVER (ORDER BY place)) AS bridge_id, cluster_id, canonical_name,
  lower(replace(canonical_name, ' ', '-')) AS slug, materials, confidence FROM titled""")
def cluster_records(spark, folder):
    """Kept clusters with their name (the first source concept's where none is given), slug, sequential id and confidence."""
    sources = _sources(spark, folder)
    grade = F.when(F.col("relevance") == "high", 1.0).when(F.col("relevance") == "medium", 0.7).otherwise(0.4)
    named = sources.groupBy("cluster_id", "place").agg(
        _canonical(sources).alias("canonical_name"), F.count_distinct("material_id").alias("materials"),
        F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.avg(grade))), 6).alias("confidence")).withColumn("all", F.lit(0))
    numbered = ops.running_number(named, ["all"], "place")
    return numbered.select(F.format_string("bridge_%04d", "number").alias("bridge_id"), "cluster_id", "canonical_name",
                           slugify(F.col("canonical_name")).alias("slug"), "materials", "confidence")


@query("cluster_aliases", "G4 G5 U3", RECORDS + """,
spelled AS (
  SELECT cluster_id, canonical_name AS alias, {'a': CAST(-1 AS BIGINT), 'b': CAST(0 AS BIGINT), 'c': ''} AS o FROM titled
  UNION ALL SELECT cluster_id, concept_name, {'a': pos, 'b': material_id, 'c': concept_key} FROM sources)
SELECT cluster_id, arg_min(alias, o) AS alias FROM spelled GROUP BY cluster_id, lower(alias)""")
def cluster_aliases(spark, folder):
    """A cluster's aliases as rows: its name, then its source concepts, each folded spelling once."""
    sources = _sources(spark, folder)
    order = F.struct(F.col("pos").alias("a"), F.col("material_id").alias("b"), F.col("concept_key").alias("c"))
    names = sources.select("cluster_id", F.col("concept_name").alias("alias"), order.alias("position"))
    zero = F.struct(F.lit(-1).cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("b"), F.lit("").alias("c"))
    own = sources.groupBy("cluster_id", "place").agg(_canonical(sources).alias("alias")).select("cluster_id", "alias", zero.alias("position"))
    return ops.first_spellings(own.unionByName(names), "cluster_id").select("cluster_id", "alias")
