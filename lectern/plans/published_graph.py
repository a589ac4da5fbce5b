"""The concept graph's tables built anew, published together and read back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators import graph_tables as ops
from lectern.operators.tables import shared_folder
from lectern.plans.corpus import table
from lectern.plans.registry import query
from lectern.sources import writers

INPUTS = """
scoped AS (
  SELECT s_suppkey AS k, s_name AS name, lower(r_name) AS domain, lower(n_name) AS collection, s_nationkey AS nation, s_acctbal AS weight
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
raw_clusters AS (
  SELECT CASE WHEN k % 50 = 0 THEN ' ' ELSE 'c' || k END AS cluster_id, CASE WHEN domain = 'asia' THEN '' ELSE domain END AS domain,
    CASE WHEN k % 4 = 0 THEN NULL ELSE collection END AS collection, name AS canonical_name, 'concept-' || k AS slug,
    weight / 10000 AS confidence, CASE WHEN k % 9 = 0 THEN 'wiki/given/' || k || '.md' ELSE '' END AS wiki_path, k AS position FROM scoped
  UNION ALL
  SELECT 'c' || k, domain, collection, 'later ' || name, 'later-' || k, 0.5, NULL, k + 1000000 FROM scoped WHERE k % 10 = 3),
raw_aliases AS (
  SELECT 'c' || l_suppkey AS cluster_id, CASE WHEN l_linenumber = 5 THEN '' ELSE l_returnflag || l_linenumber END AS alias FROM lineitem WHERE l_quantity < 10),
raw_sources AS (
  SELECT 'c' || l_suppkey AS cluster_id, CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(l_partkey AS VARCHAR) END AS material_id,
    CASE l_returnflag WHEN 'A' THEN 'high' WHEN 'N' THEN 'medium' ELSE 'low' END AS relevance, l_discount AS confidence,
    l_orderkey * 10 + l_linenumber AS position FROM lineitem),
materials AS (
  SELECT CAST(p_partkey AS VARCHAR) AS material_id, CASE WHEN p_size % 10 = 0 THEN NULL ELSE lower(p_type) END AS domain,
    CASE WHEN p_size % 7 = 0 THEN ' ' ELSE lower(replace(p_brand, '#', '_')) END AS collection, p_name AS title FROM part),
raw_bridges AS (
  SELECT CASE WHEN n_nationkey = 7 THEN '' ELSE 'b' || n_nationkey END AS bridge_id, CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE ' ' || lower(r_name) END AS domain,
    n_name AS canonical_name, 'bridge-' || n_nationkey AS slug, 'about ' || n_name AS descriptor, 0.7 AS confidence,
    CASE WHEN n_nationkey % 6 = 0 THEN 'wiki/bridge/' || n_nationkey || '.md' END AS wiki_path, n_nationkey AS position
  FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 'c' || n_nationkey, 'shared', 'twin ' || n_name, 'twin-' || n_nationkey, '', 0.1, NULL, n_nationkey FROM nation WHERE n_nationkey % 8 = 1),
raw_supports AS (
  SELECT DISTINCT 'b' || s_nationkey AS bridge_id, CAST(l_partkey AS VARCHAR) AS material_id FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_quantity > 45
  UNION ALL SELECT 'c' || n_nationkey, CAST(x AS VARCHAR) FROM nation, (SELECT unnest([1, 2]) AS x) WHERE n_nationkey % 8 = 1),
raw_members AS (
  SELECT 'b' || nation AS bridge_id, CASE WHEN k % 30 = 0 THEN NULL ELSE 'c' || k END AS cluster_id, domain, collection, 'wiki/' || k AS wiki_path,
    l_orderkey * 10 + l_linenumber AS position, CASE WHEN l_linenumber = 6 THEN ' ' ELSE CAST(l_partkey AS VARCHAR) END AS material_id
  FROM scoped JOIN lineitem ON l_suppkey = k),
raw_reviews AS (
  SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'r' || o_custkey ELSE '' END AS review_id, CASE WHEN o_orderkey % 3 = 1 THEN 'c' || o_custkey END AS cluster_id,
    CASE WHEN o_orderkey % 6 = 2 THEN 'f' || o_custkey END AS finding_id, o_orderpriority AS severity, o_orderkey AS position FROM orders),
raw_concepts AS (
  SELECT CASE WHEN o_custkey % 13 = 0 THEN '' ELSE 'c' || o_custkey END AS cluster_id, o_orderpriority AS why, o_orderkey AS position FROM orders),
raw_collections AS (
  SELECT lower(c_mktsegment) AS domain, CASE WHEN c_nationkey = 3 THEN NULL ELSE 'n' || c_nationkey END AS collection, c_name AS why, c_custkey AS position FROM customer),
raw_findings AS (
  SELECT CASE WHEN user_id % 9 = 0 THEN NULL ELSE 'g' || user_id END AS finding_id, event_type AS summary, event_id AS position FROM events)"""


def _inputs(spark, folder) -> dict[str, DataFrame]:
    s, n, r, l, p = (table(spark, folder, t) for t in ("supplier", "nation", "region", "lineitem", "part"))
    scopes = n.join(r, n.n_regionkey == r.r_regionkey).select(
        "n_nationkey", "n_name", F.lower("r_name").alias("domain"), F.lower("n_name").alias("collection"))
    scoped = s.join(scopes, s.s_nationkey == scopes.n_nationkey).select(
        F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), "domain", "collection", F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("weight"))
    k, none = F.col("k"), F.lit(None).cast("string")

    def named(prefix: str, column: str):
        return F.concat(F.lit(prefix), F.col(column).cast("string"))

    clusters = scoped.select(
        F.when(k % 50 == 0, " ").otherwise(named("c", "k")).alias("cluster_id"), F.when(F.col("domain") == "asia", "").otherwise(F.col("domain")).alias("domain"),
        F.when(k % 4 != 0, F.col("collection")).alias("collection"), F.col("name").alias("canonical_name"), named("concept-", "k").alias("slug"),
        (F.col("weight") / 10000).alias("confidence"), F.when(k % 9 == 0, F.concat(F.lit("wiki/given/"), k.cast("string"), F.lit(".md"))).otherwise("").alias("wiki_path"),
        k.cast("long").alias("position")).union(scoped.where("k % 10 = 3").select(
            named("c", "k"), "domain", "collection", F.concat(F.lit("later "), "name"), named("later-", "k"), F.lit(0.5), none, k + 1_000_000))
    place = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("position")
    part = F.col("l_partkey").cast("string")
    bridges = n.join(r, n.n_regionkey == r.r_regionkey).select(
        F.when(F.col("n_nationkey") == 7, "").otherwise(named("b", "n_nationkey")).alias("bridge_id"),
        F.when(F.col("n_nationkey") % 5 != 0, F.concat(F.lit(" "), F.lower("r_name"))).alias("domain"), F.col("n_name").alias("canonical_name"),
        named("bridge-", "n_nationkey").alias("slug"), F.concat(F.lit("about "), "n_name").alias("descriptor"), F.lit(0.7).alias("confidence"),
        F.when(F.col("n_nationkey") % 6 == 0, F.concat(F.lit("wiki/bridge/"), F.col("n_nationkey").cast("string"), F.lit(".md"))).alias("wiki_path"),
        F.col("n_nationkey").alias("position"))
    twins = n.where("n_nationkey % 8 = 1")
    bridges = bridges.union(twins.select(named("c", "n_nationkey"), F.lit("shared"), F.concat(F.lit("twin "), "n_name"), named("twin-", "n_nationkey"),
                                         F.lit(""), F.lit(0.1), none, "n_nationkey"))
    supports = l.where("l_quantity > 45").join(s, l.l_suppkey == s.s_suppkey).select(
        named("b", "s_nationkey").alias("bridge_id"), part.alias("material_id")).distinct().union(
            twins.select(named("c", "n_nationkey"), F.explode(F.array(F.lit("1"), F.lit("2")))))
    o, e = table(spark, folder, "orders"), table(spark, folder, "events")
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    return {
        "clusters": clusters,
        "aliases": l.where("l_quantity < 10").select(named("c", "l_suppkey").alias("cluster_id"), F.when(F.col("l_linenumber") == 5, "").otherwise(
            F.concat("l_returnflag", F.col("l_linenumber").cast("string"))).alias("alias")),
        "sources": l.select(named("c", "l_suppkey").alias("cluster_id"), F.when(F.col("l_linenumber") != 7, part).alias("material_id"),
                            F.when(F.col("l_returnflag") == "A", "high").when(F.col("l_returnflag") == "N", "medium").otherwise("low").alias("relevance"),
                            F.col("l_discount").alias("confidence"), place),
        "materials": p.select(F.col("p_partkey").cast("string").alias("material_id"), F.when(F.col("p_size") % 10 != 0, F.lower("p_type")).alias("domain"),
                              F.when(F.col("p_size") % 7 == 0, " ").otherwise(F.lower(F.replace("p_brand", F.lit("#"), F.lit("_")))).alias("collection"),
                              F.col("p_name").alias("title")),
        "seeds": clusters.where("collection = 'nation_6'").select("cluster_id").distinct(),
        "bridges": bridges, "supports": supports,
        "members": scoped.join(l, scoped.k == l.l_suppkey).select(
            named("b", "nation").alias("bridge_id"), F.when(k % 30 != 0, named("c", "k")).alias("cluster_id"), "domain", "collection",
            named("wiki/", "k").alias("wiki_path"), place, F.when(F.col("l_linenumber") == 6, " ").otherwise(part).alias("material_id")),
        "reviews": o.select(F.when(key % 3 == 0, named("r", "o_custkey")).otherwise("").alias("review_id"), F.when(key % 3 == 1, named("c", "o_custkey")).alias("cluster_id"),
                            F.when(key % 6 == 2, named("f", "o_custkey")).alias("finding_id"), F.col("o_orderpriority").alias("severity"), key.alias("position")),
        "concepts": o.select(F.when(customer % 13 == 0, "").otherwise(named("c", "o_custkey")).alias("cluster_id"), F.col("o_orderpriority").alias("why"), key.alias("position")),
        "collections": table(spark, folder, "customer").select(
            F.lower("c_mktsegment").alias("domain"), F.when(F.col("c_nationkey") != 3, named("n", "c_nationkey")).alias("collection"),
            F.col("c_name").alias("why"), F.col("c_custkey").alias("position")),
        "findings": e.select(F.when(F.col("user_id") % 9 != 0, named("g", "user_id")).alias("finding_id"), F.col("event_type").alias("summary"), F.col("event_id").alias("position")),
    }


#: Key and contents of each table in the one listing that the query returns.
SHOWN = {
    "clusters": ("cluster_id", "", ("domain", "collection", "canonical_name", "slug", "wiki_path", "material_count")),
    "aliases": ("cluster_id", "alias", ()),
    "cluster_materials": ("cluster_id", "material_id", ("relevance", "confidence", "material_wiki_path")),
    "relations": ("cluster_id", "related_cluster_id", ("shared_material_count",)),
    "bridge_members": ("bridge_id", "cluster_id", ("domain", "collection", "local_wiki_path", "material_count")),
    "bridges": ("bridge_id", "", ("domain", "canonical_name", "slug", "descriptor", "wiki_path", "material_count")),
    "reviews": ("review_id", "", ("cluster_id", "severity")),
    "concept_reflections": ("cluster_id", "", ("why",)),
    "collection_reflections": ("domain", "collection", ("why",)),
    "findings": ("finding_id", "", ("summary",)),
    "pages": ("page_type", "page_id", ("title", "path", "domain", "collection")),
}


def _listed() -> str:
    def value(c: str) -> str:
        return f"coalesce(CAST({'CAST(round(confidence * 100) AS BIGINT)' if c == 'confidence' else c} AS VARCHAR), '')"

    return " UNION ALL ".join(
        f"SELECT '{name}' AS part, {a} AS k1, {b or chr(39) * 2} AS k2, concat_ws('|', {', '.join(map(value, rest)) or chr(39) * 2}) AS contents FROM {name}"
        for name, (a, b, rest) in SHOWN.items())


@query("graph_published", "K4 K1 J20 U7", "WITH " + INPUTS + """,
kept AS (SELECT * FROM raw_clusters WHERE trim(cluster_id) <> '' QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY position DESC) = 1),
held AS (SELECT * FROM raw_sources WHERE material_id IS NOT NULL AND cluster_id IN (SELECT cluster_id FROM kept)
  QUALIFY row_number() OVER (PARTITION BY cluster_id, material_id ORDER BY position) = 1),
clusters AS (
  SELECT cluster_id, coalesce(nullif(domain, ''), 'practice') AS domain, coalesce(collection, '_general') AS collection, canonical_name, slug,
    coalesce(nullif(wiki_path, ''), 'wiki/' || coalesce(nullif(domain, ''), 'practice') || '/' || coalesce(collection, '_general') || '/concepts/' || slug || '.md') AS wiki_path,
    (SELECT count(*) FROM held h WHERE h.cluster_id = kept.cluster_id) AS material_count FROM kept),
aliases AS (SELECT DISTINCT cluster_id, alias FROM raw_aliases WHERE alias <> '' AND cluster_id IN (SELECT cluster_id FROM kept)),
scoped_materials AS (SELECT material_id, coalesce(domain, 'practice') AS domain, coalesce(nullif(trim(collection), ''), '_general') AS collection, title FROM materials),
cluster_materials AS (
  SELECT cluster_id, h.material_id, relevance, confidence, 'wiki/' || coalesce(m.domain, 'practice') || '/' || coalesce(m.collection, '_general') || '/' || h.material_id || '.md' AS material_wiki_path
  FROM held h LEFT JOIN scoped_materials m ON m.material_id = h.material_id),
relations AS (
  SELECT a.cluster_id, b.cluster_id AS related_cluster_id, count(*) AS shared_material_count FROM held a JOIN held b ON a.material_id = b.material_id AND a.cluster_id <> b.cluster_id
  WHERE a.cluster_id IN (SELECT cluster_id FROM raw_clusters WHERE collection = 'nation_6') GROUP BY 1, 2),
kept_bridges AS (SELECT * FROM raw_bridges WHERE bridge_id <> '' QUALIFY row_number() OVER (PARTITION BY bridge_id ORDER BY position DESC) = 1),
counted AS (SELECT b.*, (SELECT count(DISTINCT material_id) FROM raw_supports s WHERE s.bridge_id = b.bridge_id) AS material_count FROM kept_bridges b),
bridges AS (
  SELECT bridge_id, trim(coalesce(domain, '')) AS domain, canonical_name, slug, descriptor, coalesce(wiki_path,
    CASE WHEN material_count > 1 THEN 'wiki/' || coalesce(nullif(trim(domain), ''), 'shared') || '/bridge-concepts/' || slug || '.md' ELSE 'wiki/shared/concepts/' || slug || '.md' END) AS wiki_path,
    material_count FROM counted),
bridge_members AS (
  SELECT bridge_id, cluster_id, max_by(domain, position) AS domain, max_by(collection, position) AS collection, max_by(wiki_path, position) AS local_wiki_path,
    count(DISTINCT nullif(trim(material_id), '')) AS material_count FROM raw_members WHERE cluster_id IS NOT NULL GROUP BY 1, 2),
reviews AS (
  SELECT coalesce(nullif(review_id, ''), cluster_id, finding_id) AS review_id, cluster_id, severity FROM raw_reviews
  WHERE coalesce(nullif(review_id, ''), cluster_id, finding_id) IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY coalesce(nullif(review_id, ''), cluster_id, finding_id) ORDER BY position DESC) = 1),
concept_reflections AS (SELECT cluster_id, max_by(why, position) AS why FROM raw_concepts WHERE cluster_id <> '' GROUP BY 1),
collection_reflections AS (SELECT domain, collection, max_by(why, position) AS why FROM raw_collections WHERE collection IS NOT NULL GROUP BY 1, 2),
findings AS (SELECT finding_id, max_by(summary, position) AS summary FROM raw_findings WHERE finding_id IS NOT NULL GROUP BY 1),
pages AS (
  SELECT 'concept' AS page_type, cluster_id AS page_id, canonical_name AS title, wiki_path AS path, domain, collection FROM clusters
  UNION ALL SELECT 'concept', bridge_id, canonical_name, wiki_path, coalesce(nullif(domain, ''), 'shared'), 'bridge-concepts' FROM bridges
    WHERE material_count > 1 AND bridge_id NOT IN (SELECT cluster_id FROM clusters)
  UNION ALL SELECT 'material', material_id, title, 'wiki/' || domain || '/' || collection || '/' || material_id || '.md', domain, collection FROM scoped_materials
  UNION ALL SELECT DISTINCT 'collection', domain || '/' || collection, upper(left(domain, 1)) || substr(domain, 2) || ' / ' ||
    array_to_string(list_transform(string_split(replace(collection, '_', ' '), ' '), lambda w: upper(left(w, 1)) || substr(w, 2)), ' '), 'wiki/' || domain || '/' || collection || '/_index.md', domain, collection FROM scoped_materials
  UNION ALL SELECT 'concept_index', 'local', 'Local Concepts', 'wiki/shared/concepts/_index.md', 'shared', 'concepts'
  UNION ALL SELECT 'glossary', 'bridge', 'Main Concepts', 'wiki/shared/glossary/_index.md', 'shared', 'glossary')
""" + _listed())
def graph_published(spark, folder):
    """Eleven tables of the concept graph, built from their inputs, published by one commit, read back and listed."""
    i = _inputs(spark, folder)
    tables = ops.graph_tables(
        ops.local_tables(i["clusters"], i["aliases"], i["sources"], i["materials"], i["seeds"]),
        ops.bridge_tables(i["bridges"], i["supports"], i["members"]),
        ops.note_tables(i["reviews"], i["concepts"], i["collections"], i["findings"]), i["materials"])
    path = shared_folder(spark, "graph")
    writers.publish_all(tables, path)
    found = writers.published_all(spark, path, list(ops.TABLES))

    def listed(name: str) -> DataFrame:
        a, b, rest = SHOWN[name]
        values = [F.coalesce((F.round(F.col(c) * 100).cast("long") if c == "confidence" else F.col(c)).cast("string"), F.lit("")) for c in rest]
        return found[name].select(F.lit(name).alias("part"), F.col(a).alias("k1"), (F.col(b) if b else F.lit("")).alias("k2"),
                                  F.concat_ws("|", *values).alias("contents"))

    return reduce(DataFrame.union, map(listed, SHOWN))
