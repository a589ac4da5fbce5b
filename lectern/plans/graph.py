"""Membership graph: materials, local clusters and bridges."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.operators import graph as ops
from lectern.plans import corpus
from lectern.plans.corpus import CLUSTERS, CONCEPTS, MATERIALS, MEMBERSHIPS, table, with_ctes
from lectern.plans.registry import query

HITS = "cluster_id, canonical_name, domain, collection"


def _hit(df):
    return df.select("cluster_id", "canonical_name", "domain", "collection")


@query("clusters_of_material", "J6 O7", with_ctes(CLUSTERS) + f"""
SELECT {HITS} FROM clusters WHERE cluster_id IN (SELECT l_suppkey FROM lineitem WHERE l_partkey = 7)
ORDER BY canonical_name, cluster_id""")
def clusters_of_material(spark, folder):
    ids = table(spark, folder, "lineitem").where("l_partkey = 7").select(F.col("l_suppkey").alias("cluster_id"))
    return _hit(corpus.clusters(spark, folder).join(ids, "cluster_id", "left_semi")).orderBy("canonical_name", "cluster_id")


@query("clusters_of_collection", "O7", with_ctes(CLUSTERS) + f"""
SELECT {HITS} FROM clusters WHERE domain = 'america' AND collection = 'nation_6' ORDER BY canonical_name, cluster_id""")
def clusters_of_collection(spark, folder):
    found = corpus.clusters(spark, folder).where("domain = 'america' AND collection = 'nation_6'")
    return _hit(found).orderBy("canonical_name", "cluster_id")


@query("bridges_of_cluster", "J7", """
SELECT n_nationkey AS bridge_id, n_name AS canonical_name, n_regionkey AS parent_id
FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_suppkey = 11 ORDER BY 2, 1""")
def bridges_of_cluster(spark, folder):
    mine = table(spark, folder, "supplier").where("s_suppkey = 11").select(F.col("s_nationkey").alias("n_nationkey"))
    return table(spark, folder, "nation").join(mine, "n_nationkey").select(
        F.col("n_nationkey").alias("bridge_id"), F.col("n_name").alias("canonical_name"),
        F.col("n_regionkey").alias("parent_id")).orderBy("canonical_name", "bridge_id")


@query("members_of_bridge", "J8 O7", with_ctes(CLUSTERS) + f"""
SELECT {HITS} FROM clusters WHERE bridge_id = 6 ORDER BY domain, collection, canonical_name, cluster_id""")
def members_of_bridge(spark, folder):
    found = corpus.clusters(spark, folder).where("bridge_id = 6")
    return _hit(found).orderBy("domain", "collection", "canonical_name", "cluster_id")


@query("materials_of_concept", "J14", """
SELECT p_partkey AS material_id, p_name AS title FROM part
WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_suppkey = 3) ORDER BY 1""")
def materials_of_concept(spark, folder):
    ids = table(spark, folder, "lineitem").where("l_suppkey = 3").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, folder, "part").join(ids, "p_partkey", "left_semi").select(
        F.col("p_partkey").alias("material_id"), F.col("p_name").alias("title")).orderBy("material_id")


@query("semi_domain_counts", "J16", with_ctes(corpus.CHUNKS, corpus.ANNOTATIONS, corpus.FIGURES) + """,
dom AS (SELECT doc_id FROM documents WHERE lang = 'en')
SELECT 'chunks' AS kind, count(*) AS n FROM chunks WHERE material_id IN (SELECT doc_id FROM dom)
UNION ALL SELECT 'annotations', count(*) FROM annotations WHERE material_id IN (SELECT doc_id FROM dom)
UNION ALL SELECT 'figures', count(*) FROM figures WHERE material_id IN (SELECT doc_id FROM dom)""")
def semi_domain_counts(spark, folder):
    ids = table(spark, folder, "documents").where("lang = 'en'").select(F.col("doc_id").alias("material_id"))
    kinds = {"chunks": corpus.chunks, "annotations": corpus.annotations, "figures": corpus.figures}
    counted = [
        build(spark, folder).join(ids, "material_id", "left_semi").agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")
        for kind, build in kinds.items()
    ]
    return counted[0].unionByName(counted[1]).unionByName(counted[2])


@query("figures_with_materials", "J15 F12", with_ctes(corpus.FIGURES) + """
SELECT f.material_id, f.figure_id, f.image_path, d.lang AS domain
FROM figures f JOIN documents d ON d.doc_id = f.material_id WHERE f.image_path <> ''""")
def figures_with_materials(spark, folder):
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("material_id"), F.col("lang").alias("domain"))
    return corpus.figures(spark, folder).where("image_path != ''").join(docs, "material_id").select(
        "material_id", "figure_id", "image_path", "domain")


COOC = """,
seeds AS (SELECT cluster_id FROM clusters WHERE collection = 'nation_6'),
pairs AS (
  SELECT a.cluster_id, b.cluster_id AS related_cluster_id, a.material_id
  FROM memberships a JOIN seeds USING (cluster_id) JOIN memberships b ON a.material_id = b.material_id
  WHERE a.cluster_id <> b.cluster_id)"""


def _seed_pairs(spark, folder):
    seeds = corpus.clusters(spark, folder).where("collection = 'nation_6'").select("cluster_id")
    return ops.relations_of(corpus.memberships(spark, folder), seeds)


@query("cluster_cooccurrence", "J20", with_ctes(CLUSTERS, MEMBERSHIPS) + COOC + """
SELECT cluster_id, related_cluster_id, count(*) AS shared_material_count FROM pairs GROUP BY 1, 2""")
def cluster_cooccurrence(spark, folder):
    return _seed_pairs(spark, folder).groupBy("cluster_id", "related_cluster_id").agg(
        F.count(F.lit(1)).alias("shared_material_count"))


@query("cluster_cooccurrence_materials", "J20", with_ctes(CLUSTERS, MEMBERSHIPS) + COOC + """
SELECT cluster_id, related_cluster_id, material_id FROM pairs""")
def cluster_cooccurrence_materials(spark, folder):
    return _seed_pairs(spark, folder)


@query("overlap_concepts", "J18 U5", with_ctes(CLUSTERS, MEMBERSHIPS) + """
SELECT DISTINCT c.cluster_id, c.canonical_name FROM memberships a JOIN memberships b ON a.material_id = b.material_id
JOIN clusters c ON c.cluster_id = b.cluster_id
WHERE a.cluster_id = 11 AND lower(c.canonical_name) <> (SELECT lower(canonical_name) FROM clusters WHERE cluster_id = 11)""")
def overlap_concepts(spark, folder):
    rows = corpus.clusters(spark, folder)
    slug = rows.where("cluster_id = 11").select(F.lower("canonical_name")).scalar()
    ids = ops.overlapping(corpus.memberships(spark, folder), "cluster_id", "material_id", 11)
    return rows.where(F.lower("canonical_name") != slug).join(ids, "cluster_id", "left_semi").select("cluster_id", "canonical_name")


@query("bridges_sharing_members", "J19 U5", """
SELECT DISTINCT b.l_orderkey AS bridge_id FROM lineitem a JOIN lineitem b ON a.l_suppkey = b.l_suppkey
WHERE a.l_orderkey = 32 AND b.l_orderkey <> 32""")
def bridges_sharing_members(spark, folder):
    rows = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("bridge_id"), F.col("l_suppkey").alias("cluster_id"))
    return ops.overlapping(rows, "bridge_id", "cluster_id", 32)


@query("membership_titles", "J21 H17", """
SELECT DISTINCT l_suppkey AS cluster_id, l_partkey AS material_id, coalesce(p_name, '') AS title,
       'wiki/practice/_general/' || l_partkey || '.md' AS path
FROM lineitem LEFT JOIN part ON p_partkey = l_partkey""")
def membership_titles(spark, folder):
    from lectern.functions.names import material_path

    parts = table(spark, folder, "part").select(F.col("p_partkey").alias("material_id"), F.col("p_name").alias("title"))
    return corpus.memberships(spark, folder).join(parts, "material_id", "left").select(
        "cluster_id", "material_id", F.coalesce("title", F.lit("")).alias("title"),
        material_path(F.lit(""), F.lit(None).cast("string"), F.col("material_id")).alias("path"))


@query("distinct_material_counts", "A11", """
SELECT l_suppkey AS cluster_id, count(DISTINCT l_partkey) AS material_count, min(l_partkey) AS first_material
FROM lineitem GROUP BY 1""")
def distinct_material_counts(spark, folder):
    return corpus.memberships(spark, folder).groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("material_count"), F.min("material_id").alias("first_material"))


@query("graph_health_counters", "A20", with_ctes(CLUSTERS, MEMBERSHIPS) + """,
per_cluster AS (SELECT cluster_id, count(*) AS n FROM memberships GROUP BY 1),
per_bridge AS (SELECT bridge_id, count(DISTINCT collection) AS k, count(*) AS n, max(CASE WHEN weight > 9000 THEN 1 ELSE 0 END) AS r FROM clusters GROUP BY 1)
SELECT (SELECT count(DISTINCT material_id) FROM memberships) AS materials,
       (SELECT count(*) FROM clusters) AS clusters,
       (SELECT count(*) FROM per_cluster WHERE n > 1) AS multi_material,
       (SELECT count(*) FROM per_bridge WHERE n > 1) AS multi_member_bridges,
       (SELECT count(*) FROM per_bridge WHERE r = 1) AS with_reflection""")
def graph_health_counters(spark, folder):
    members = corpus.memberships(spark, folder)
    rows = corpus.clusters(spark, folder)
    per_cluster = members.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))
    per_bridge = rows.groupBy("bridge_id").agg(F.count(F.lit(1)).alias("n"), F.max((F.col("weight") > 9000).cast("int")).alias("r"))
    one = per_bridge.agg(F.count_if(F.col("n") > 1).alias("multi_member_bridges"), F.count_if(F.col("r") == 1).alias("with_reflection"))
    return one.select(
        members.select("material_id").distinct().agg(F.count(F.lit(1))).scalar().alias("materials"),
        rows.agg(F.count(F.lit(1))).scalar().alias("clusters"),
        per_cluster.agg(F.count_if(F.col("n") > 1)).scalar().alias("multi_material"),
        "multi_member_bridges", "with_reflection")


@query("scope_cluster_totals", "A21 A23", with_ctes(CLUSTERS, MEMBERSHIPS) + """,
per_cluster AS (SELECT cluster_id, count(*) AS n FROM memberships GROUP BY 1)
SELECT domain, collection, count(*) AS clusters, CAST(count_if(coalesce(n, 0) > 1) AS BIGINT) AS multi_material,
       CAST(sum(coalesce(n, 0)) AS BIGINT) AS memberships
FROM clusters LEFT JOIN per_cluster USING (cluster_id) GROUP BY 1, 2""")
def scope_cluster_totals(spark, folder):
    per_cluster = corpus.memberships(spark, folder).groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))
    n = F.coalesce("n", F.lit(0))
    return corpus.clusters(spark, folder).join(per_cluster, "cluster_id", "left").groupBy("domain", "collection").agg(
        F.count(F.lit(1)).alias("clusters"), F.count_if(n > 1).alias("multi_material"), F.sum(n).alias("memberships"))


@query("scope_overlap_clusters", "J31 H18", with_ctes(CLUSTERS, MEMBERSHIPS) + """,
scope AS (SELECT p_partkey AS material_id FROM part WHERE p_brand = 'Brand#7')
SELECT c.cluster_id, c.canonical_name, count(*) AS material_count
FROM memberships m SEMI JOIN scope USING (material_id) JOIN clusters c USING (cluster_id)
WHERE c.domain = 'asia' GROUP BY 1, 2""")
def scope_overlap_clusters(spark, folder):
    scope = table(spark, folder, "part").where("p_brand = 'Brand#7'").select(F.col("p_partkey").alias("material_id"))
    hit = corpus.memberships(spark, folder).join(scope, "material_id", "left_semi")
    counts = hit.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("material_count"))
    return counts.join(corpus.clusters(spark, folder).where("domain = 'asia'"), "cluster_id").select(
        "cluster_id", "canonical_name", "material_count")


@query("key_concepts_of_collection", "J33", with_ctes(CONCEPTS) + """
SELECT concept_key, count(DISTINCT c.material_id) AS material_count,
       CAST(sum(CASE relevance WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END) AS BIGINT) AS relevance_points
FROM concepts c JOIN documents d ON d.doc_id = c.material_id WHERE d.source = 'src3'
GROUP BY 1 ORDER BY 2 DESC, 3 DESC, 1""")
def key_concepts_of_collection(spark, folder):
    scope = table(spark, folder, "documents").where("source = 'src3'").select(F.col("doc_id").alias("material_id"))
    rows = corpus.concepts(spark, folder).join(scope, "material_id", "left_semi")
    return ops.key_concepts(rows).orderBy(F.desc("material_count"), F.desc("relevance_points"), "concept_key")


@query("registry_fallback", "J34", with_ctes(CLUSTERS) + """,
pages_reg AS (SELECT 'page' AS kind, 0 AS pri, s_name AS path, 'P' || s_suppkey AS title FROM supplier WHERE s_acctbal > 0),
cl AS (SELECT 'cluster', 1, canonical_name, 'C' || cluster_id FROM clusters),
br AS (SELECT 'bridge', 2, n_name, 'B' || n_nationkey FROM nation),
u AS (SELECT * FROM pages_reg UNION ALL SELECT * FROM cl UNION ALL SELECT * FROM br)
SELECT path, arg_min(kind, pri) AS kind, arg_min(title, pri) AS title FROM u GROUP BY path""")
def registry_fallback(spark, folder):
    s, n = table(spark, folder, "supplier"), table(spark, folder, "nation")
    text = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    sources = [
        s.where("s_acctbal > 0").select(F.lit("page").alias("kind"), F.col("s_name").alias("path"), text("P", "s_suppkey").alias("title")),
        corpus.clusters(spark, folder).select(F.lit("cluster").alias("kind"), F.col("canonical_name").alias("path"), text("C", "cluster_id").alias("title")),
        n.select(F.lit("bridge").alias("kind"), F.col("n_name").alias("path"), text("B", "n_nationkey").alias("title")),
    ]
    return ops.first_source(sources, "path")


@query("scopes_distinct", "U8 O12", "SELECT DISTINCT lang AS domain, source AS collection FROM documents ORDER BY 1, 2")
def scopes_distinct(spark, folder):
    return table(spark, folder, "documents").select(
        F.col("lang").alias("domain"), F.col("source").alias("collection")).distinct().orderBy("domain", "collection")


@query("uncovered_concepts", "F16 U4 H3", with_ctes(CONCEPTS) + """
SELECT c.material_id, c.concept_key FROM concepts c
ANTI JOIN (SELECT l.doc_id AS material_id FROM labels l WHERE quality = 1) q ON q.material_id = c.material_id AND c.relevance <> 'low'""")
def uncovered_concepts(spark, folder):
    covered = table(spark, folder, "labels").where("quality = 1").select(F.col("doc_id").alias("material_id"))
    rows = corpus.concepts(spark, folder)
    pairs = rows.where("relevance != 'low'").join(covered, "material_id", "left_semi").select("material_id", "concept_key")
    return rows.join(pairs, ["material_id", "concept_key"], "left_anti").select("material_id", "concept_key")


@query("eligible_concept_reflections", "H8", with_ctes(CONCEPTS) + """
SELECT concept_key, count(*) AS material_count FROM concepts GROUP BY 1 HAVING count(*) >= 2""")
def eligible_concept_reflections(spark, folder):
    return corpus.concepts(spark, folder).groupBy("concept_key").agg(F.count(F.lit(1)).alias("material_count")).where("material_count >= 2")
