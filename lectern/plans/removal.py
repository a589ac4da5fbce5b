"""Removals over manifest, extracted folders, pages and clusters: a dry run, and the stores afterwards."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.names import material_path
from lectern.operators import removal as ops
from lectern.operators.tables import shared_folder
from lectern.plans.corpus import table
from lectern.plans.registry import query
from lectern.sources import writers

STORES = """
m AS (SELECT CAST(p_partkey AS VARCHAR) AS id, lower(p_type) AS domain, lower(replace(p_brand, '#', '')) AS collection, p_partkey AS k FROM part),
manifest AS (SELECT id AS material_id, domain, collection FROM m WHERE k % 7 <> 0),
extracted AS (SELECT id AS material_id, CASE WHEN k % 11 = 0 THEN 'moved' ELSE domain END AS domain, collection FROM m WHERE k % 5 <> 0),
clusters AS (
  SELECT 'c' || o_orderkey AS cluster_id, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'wiki/concepts/' || o_orderkey || '.md' END AS wiki_path,
    'derived/' || (o_orderkey % 50) || '/clusters.jsonl' AS file FROM orders),
members AS (SELECT DISTINCT 'c' || l_orderkey AS cluster_id, CAST(l_partkey AS VARCHAR) AS material_id FROM lineitem),
pages AS (
  SELECT 'wiki/' || domain || '/' || collection || '/' || material_id || '.md' AS path FROM extracted WHERE CAST(material_id AS BIGINT) % 9 <> 0
  UNION SELECT wiki_path FROM clusters WHERE wiki_path IS NOT NULL AND wiki_path NOT LIKE '%8.md'),
asked AS (SELECT id AS material_id FROM m WHERE k % 6 = 0 UNION SELECT 'x' || n_nationkey FROM nation),
scopes AS (SELECT material_id, coalesce(e.domain, f.domain) AS domain, coalesce(e.collection, f.collection) AS collection
  FROM manifest f FULL OUTER JOIN extracted e USING (material_id)),
left_over AS (SELECT * FROM members WHERE material_id NOT IN (SELECT material_id FROM asked)),
hit AS (
  SELECT cluster_id, wiki_path, file, (SELECT count(*) FROM left_over l WHERE l.cluster_id = c.cluster_id) < 2 AS collapses
  FROM clusters c WHERE cluster_id IN (SELECT cluster_id FROM members WHERE material_id IN (SELECT material_id FROM asked))),
gone AS (
  SELECT path FROM pages WHERE path IN (SELECT 'wiki/' || domain || '/' || collection || '/' || material_id || '.md' FROM scopes WHERE material_id IN (SELECT material_id FROM asked))
    OR path IN (SELECT wiki_path FROM hit WHERE collapses AND wiki_path IS NOT NULL))"""


def _stores(spark, folder) -> tuple[dict[str, DataFrame], DataFrame]:
    k = F.col("p_partkey")
    m = table(spark, folder, "part").select(
        k.cast("string").alias("material_id"), F.lower("p_type").alias("domain"), F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))).alias("collection"), k)
    extracted = m.where("p_partkey % 5 <> 0").withColumn("domain", F.when(k % 11 == 0, "moved").otherwise(F.col("domain")))
    o, key = table(spark, folder, "orders"), F.col("o_orderkey")
    clusters = o.select(
        F.concat(F.lit("c"), key.cast("string")).alias("cluster_id"), F.when(key % 3 != 0, F.concat(F.lit("wiki/concepts/"), key.cast("string"), F.lit(".md"))).alias("wiki_path"),
        F.concat(F.lit("derived/"), (key % 50).cast("string"), F.lit("/clusters.jsonl")).alias("file"))
    members = table(spark, folder, "lineitem").select(
        F.concat(F.lit("c"), F.col("l_orderkey").cast("string")).alias("cluster_id"), F.col("l_partkey").cast("string").alias("material_id"))
    pages = extracted.where("p_partkey % 9 <> 0").select(material_path(F.col("domain"), F.col("collection"), F.col("material_id")).alias("path")).union(
        clusters.where("wiki_path IS NOT NULL AND wiki_path NOT LIKE '%8.md'").select("wiki_path")).distinct()
    asked = m.where("p_partkey % 6 = 0").select("material_id").union(
        table(spark, folder, "nation").select(F.concat(F.lit("x"), F.col("n_nationkey").cast("string"))))
    return {"manifest": m.where("p_partkey % 7 <> 0").drop("p_partkey"), "extracted": extracted.drop("p_partkey"), "pages": pages,
            "clusters": clusters, "members": members}, asked


@query("removal_dry_run", "K8 H19", "WITH " + STORES + """
SELECT 'removed material' AS kind, material_id AS id FROM manifest WHERE material_id IN (SELECT material_id FROM asked)
UNION ALL SELECT 'missing material', material_id FROM asked WHERE material_id NOT IN (SELECT material_id FROM scopes)
UNION ALL SELECT 'touched path', 'extracted/' || material_id FROM extracted WHERE material_id IN (SELECT material_id FROM asked)
UNION ALL SELECT 'touched path', path FROM gone
UNION ALL SELECT 'collapsed cluster', cluster_id FROM hit WHERE collapses
UNION ALL SELECT DISTINCT 'rewritten file', file FROM hit
UNION ALL SELECT DISTINCT 'touched path', file FROM hit""")
def removal_dry_run(spark, folder):
    """All that removing some materials would find and touch."""
    return ops.report(*_stores(spark, folder))


@query("removal_applied", "K8 H19 K1", "WITH " + STORES + """
SELECT 'manifest' AS store, material_id AS a, '' AS b FROM manifest WHERE material_id NOT IN (SELECT material_id FROM asked)
UNION ALL SELECT 'extracted', material_id, '' FROM extracted WHERE material_id NOT IN (SELECT material_id FROM asked)
UNION ALL SELECT 'pages', path, '' FROM pages WHERE path NOT IN (SELECT path FROM gone)
UNION ALL SELECT 'clusters', cluster_id, file FROM clusters WHERE cluster_id NOT IN (SELECT cluster_id FROM hit WHERE collapses)
UNION ALL SELECT 'members', cluster_id, material_id FROM left_over WHERE cluster_id NOT IN (SELECT cluster_id FROM hit WHERE collapses)""")
def removal_applied(spark, folder):
    """The stores after a removal, published together and read back."""
    path = shared_folder(spark, "removal")
    stores, asked = _stores(spark, folder)
    writers.publish_all(ops.without({**stores, "members": stores["members"].distinct()}, asked), path)
    found = writers.published_all(spark, path, list(ops.STORES))
    shown = {"manifest": ("material_id", None), "extracted": ("material_id", None), "pages": ("path", None), "clusters": ("cluster_id", "file"),
             "members": ("cluster_id", "material_id")}
    return reduce(DataFrame.union, [found[name].select(F.lit(name).alias("store"), F.col(a).alias("a"), (F.col(b) if b else F.lit("")).alias("b"))
                                    for name, (a, b) in shown.items()])
