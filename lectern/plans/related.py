"""Related-material queries seeded by one material."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions.fixed import PAGE_RELATED_WEIGHTS, SEARCH_RELATED_WEIGHTS
from lectern.functions.names import concept_key
from lectern.operators import related as ops
from lectern.plans import corpus
from lectern.plans.corpus import CATALOGUE, CONCEPTS, MEMBERSHIPS, table, with_ctes
from lectern.plans.registry import query

SEED = 7
DOC_SEED = 1
FACETS = ["building_type", "scale"]


def _supplier_links(spark, folder, seed):
    """Seed-side cut first: only the seed's clusters are joined back to the table."""
    rows = table(spark, folder, "lineitem").select(F.col("l_suppkey").alias("cluster_id"), F.col("l_partkey").alias("material_id"))
    mine = rows.where(F.col("material_id") == seed).select("cluster_id").distinct()
    names = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("cluster_id"), F.col("s_name").alias("value"))
    others = rows.where(F.col("material_id") != seed).join(mine, "cluster_id", "left_semi").distinct()
    return others.join(names, "cluster_id").select(
        "material_id", F.lit("shared_local_cluster").alias("type"), F.lit("").alias("facet"), "value")


def _keywords(cat):
    return cat.select("material_id", F.explode(F.array_distinct("keywords")).alias("keyword"))


def _signals(spark, folder, seed):
    cat = corpus.catalogue(spark, folder)
    keyed = cat.select("material_id", "title", concept_key(F.col("title")).alias("concept_key"))
    return {
        "cluster": _supplier_links(spark, folder, seed),
        "concept": ops.shared_attribute(keyed, seed, "concept_key", "shared_concept", F.col("title")),
        "keyword": ops.shared_attribute(_keywords(cat), seed, "keyword", "shared_keyword"),
        "author": ops.shared_attribute(cat.select("material_id", "author"), seed, "author", "shared_author"),
        "facet": ops.shared_facets(cat, seed, FACETS),
    }


CLUSTER_SIGNAL = f"""
cluster_signal AS (
  SELECT b.material_id, 'shared_local_cluster' AS type, '' AS facet, s_name AS value
  FROM memberships a JOIN memberships b ON a.cluster_id = b.cluster_id JOIN supplier ON s_suppkey = a.cluster_id
  WHERE a.material_id = {SEED} AND b.material_id <> {SEED})"""
KEYWORD_SIGNAL = f"""
kw AS (SELECT DISTINCT material_id, unnest(keywords) AS keyword FROM catalogue),
keyword_signal AS (
  SELECT b.material_id, 'shared_keyword' AS type, '' AS facet, a.keyword AS value
  FROM kw a JOIN kw b USING (keyword) WHERE a.material_id = {SEED} AND b.material_id <> {SEED})"""
AUTHOR_SIGNAL = f"""
author_signal AS (
  SELECT b.material_id, 'shared_author' AS type, '' AS facet, a.author AS value
  FROM catalogue a JOIN catalogue b USING (author) WHERE a.material_id = {SEED} AND b.material_id <> {SEED})"""
FACET_SIGNAL = f"""
fl AS (SELECT material_id, 'building_type' AS facet, building_type AS value FROM catalogue
       UNION ALL SELECT material_id, 'scale', scale FROM catalogue),
facet_signal AS (
  SELECT b.material_id, 'shared_facet' AS type, a.facet, trim(a.value) AS value
  FROM fl a JOIN fl b ON a.facet = b.facet AND lower(trim(a.value)) = lower(trim(b.value))
  WHERE a.material_id = {SEED} AND b.material_id <> {SEED} AND trim(a.value) <> '')"""
CONCEPT_SIGNAL = f"""
ck AS (
  SELECT material_id, title, CASE WHEN regexp_matches(title, '(ses|xes|zes|ches|shes)$') THEN left(title, length(title) - 2)
    WHEN title LIKE '%s' AND NOT regexp_matches(title, '(ss|us|is)$') THEN left(title, length(title) - 1) ELSE title END AS concept_key
  FROM catalogue),
concept_signal AS (
  SELECT b.material_id, 'shared_concept' AS type, '' AS facet, a.title AS value
  FROM ck a JOIN ck b USING (concept_key) WHERE a.material_id = {SEED} AND b.material_id <> {SEED})"""
COLUMNS = "material_id, type, facet, value"


@query("related_shared_cluster", "J9", with_ctes(MEMBERSHIPS, CLUSTER_SIGNAL) + f"SELECT {COLUMNS} FROM cluster_signal")
def related_shared_cluster(spark, folder):
    return _supplier_links(spark, folder, SEED)


@query("related_shared_concept", "J10", with_ctes(CONCEPTS) + f"""
SELECT b.material_id, 'shared_concept' AS type, '' AS facet, a.concept_name AS value
FROM concepts a JOIN concepts b USING (concept_key) WHERE a.material_id = {DOC_SEED} AND b.material_id <> {DOC_SEED}""")
def related_shared_concept(spark, folder):
    return ops.shared_attribute(corpus.concepts(spark, folder), DOC_SEED, "concept_key", "shared_concept", F.col("concept_name")).select(*ops.SIGNAL)


@query("related_shared_keyword", "J11", with_ctes(CATALOGUE, KEYWORD_SIGNAL) + f"SELECT {COLUMNS} FROM keyword_signal")
def related_shared_keyword(spark, folder):
    return _signals(spark, folder, SEED)["keyword"].select(*ops.SIGNAL)


@query("related_shared_author", "J12", with_ctes(CATALOGUE, AUTHOR_SIGNAL) + f"SELECT {COLUMNS} FROM author_signal")
def related_shared_author(spark, folder):
    return _signals(spark, folder, SEED)["author"].select(*ops.SIGNAL)


@query("related_shared_facets", "J13", with_ctes(CATALOGUE, FACET_SIGNAL) + f"SELECT {COLUMNS} FROM facet_signal")
def related_shared_facets(spark, folder):
    return _signals(spark, folder, SEED)["facet"].select(*ops.SIGNAL)


WEIGHTED = """
weighted AS (
  SELECT *, 2.5 AS weight FROM cluster_signal UNION ALL SELECT *, 1.0 FROM concept_signal
  UNION ALL SELECT *, 0.8 FROM author_signal UNION ALL SELECT *, 0.5 FROM facet_signal
  UNION ALL SELECT *, 0.3 FROM keyword_signal),
scores AS (
  SELECT material_id, round(CAST(sum(weight) AS DOUBLE), 3) AS score, count(*) AS connections FROM weighted GROUP BY 1),
top AS (
  SELECT *, row_number() OVER (ORDER BY score DESC, material_id) AS rank FROM scores ORDER BY score DESC, material_id LIMIT 10)"""
SEARCH_SIDE = with_ctes(MEMBERSHIPS, CATALOGUE, CLUSTER_SIGNAL, KEYWORD_SIGNAL, AUTHOR_SIGNAL, FACET_SIGNAL, CONCEPT_SIGNAL, WEIGHTED)


def _search_weighted(spark, folder):
    return ops.weigh(list(_signals(spark, folder, SEED).values()), SEARCH_RELATED_WEIGHTS)


@query("related_weighted_union", "G1 A6 O4", SEARCH_SIDE + """
SELECT t.material_id, title, score, connections, rank FROM top t JOIN catalogue USING (material_id)""")
def related_weighted_union(spark, folder):
    top = ops.related(_search_weighted(spark, folder), 10)
    titles = corpus.catalogue(spark, folder).select("material_id", "title")
    return titles.join(top, "material_id").select("material_id", "title", "score", "connections", "rank")


@query("related_connections", "G1 P13 A6", SEARCH_SIDE + """
SELECT material_id, rank, CASE type
  WHEN 'shared_local_cluster' THEN 'shared local home: ' || value WHEN 'shared_concept' THEN 'shared concept: ' || value
  WHEN 'shared_keyword' THEN 'shared keyword: ' || value WHEN 'shared_author' THEN 'shared author: ' || value
  ELSE 'shared facet [' || facet || ']: ' || value END AS label
FROM weighted JOIN top USING (material_id)""")
def related_connections(spark, folder):
    weighted = _search_weighted(spark, folder)
    return ops.connections(weighted, ops.related(weighted, 10))


PAGE_SIDE = with_ctes(MEMBERSHIPS, CATALOGUE, CLUSTER_SIGNAL, KEYWORD_SIGNAL, AUTHOR_SIGNAL, FACET_SIGNAL, """
weighted AS (
  SELECT *, 3 AS weight, 0 AS o FROM cluster_signal UNION ALL SELECT *, 1, 1 FROM keyword_signal
  UNION ALL SELECT *, 2, 2 FROM author_signal UNION ALL SELECT *, 1, 3 FROM facet_signal),
scores AS (
  SELECT material_id, round(CAST(sum(weight) AS DOUBLE), 3) AS score, count(*) AS connections FROM weighted GROUP BY 1),
top AS (
  SELECT *, row_number() OVER (ORDER BY score DESC, material_id) AS rank FROM scores ORDER BY score DESC, material_id LIMIT 10)""")


def _page_weighted(spark, folder):
    s = _signals(spark, folder, SEED)
    exact = ops.shared_facets(corpus.catalogue(spark, folder), SEED, FACETS, folded=False)
    return ops.weigh([s["cluster"], s["keyword"], s["author"], exact], PAGE_RELATED_WEIGHTS)


@query("related_compile_weights", "G2 J17", PAGE_SIDE + "SELECT material_id, score, connections, rank FROM top")
def related_compile_weights(spark, folder):
    return ops.related(_page_weighted(spark, folder), 10).select("material_id", "score", "connections", "rank")


@query("related_compile_reasons", "G2 J17", PAGE_SIDE + """,
reasons AS (
  SELECT DISTINCT material_id, o, CASE type WHEN 'shared_local_cluster' THEN 'shared concept: ' || value
    WHEN 'shared_keyword' THEN 'shared keyword: ' || value WHEN 'shared_author' THEN 'shared author: ' || value
    ELSE 'shared ' || replace(facet, '_', ' ') || ': ' || value END AS reason
  FROM weighted SEMI JOIN top USING (material_id))
SELECT material_id, reason, n FROM (
  SELECT material_id, reason, row_number() OVER (PARTITION BY material_id ORDER BY o, reason) AS n FROM reasons) WHERE n <= 5""")
def related_compile_reasons(spark, folder):
    weighted = _page_weighted(spark, folder)
    order = {"shared_local_cluster": 0, "shared_keyword": 1, "shared_author": 2, "shared_facet": 3}
    return ops.page_reasons(weighted, ops.related(weighted, 10), order)
