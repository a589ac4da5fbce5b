"""Incremental and change-driven queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions.lists import canonical_hash, content_hash
from lectern.functions.text import text_or_empty
from lectern.operators import incremental as ops
from lectern.plans import corpus
from lectern.plans.corpus import MEMBERSHIPS, table, with_ctes
from lectern.plans.registry import query


@query("fingerprints", "A25 G18", """
SELECT doc_id, substr(sha256(CAST(to_json({'p0': lang, 'p1': source, 'p2': sha256(text)}) AS VARCHAR)), 1, 16) AS fingerprint FROM documents""")
def fingerprints(spark, folder):
    return table(spark, folder, "documents").select(
        "doc_id", canonical_hash(F.col("lang"), F.col("source"), content_hash(F.col("text"))).alias("fingerprint"))


@query("stale_items", "G17 R10", """
SELECT o_orderkey FROM orders LEFT JOIN (SELECT l_orderkey, max(l_linenumber) AS v FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey
WHERE v IS NULL OR v <> 7""")
def stale_items(spark, folder):
    current = table(spark, folder, "orders").select("o_orderkey", F.lit(7).alias("version"))
    stored = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_linenumber").alias("version"))
    return ops.stale_rows(current, stored, "o_orderkey", ["version"]).select("o_orderkey")


@query("pending_since_watermark", "F10 R6", """
SELECT event_id FROM events WHERE event_type = 'error' OR ts > TIMESTAMP '2024-01-15 00:00:00'""")
def pending_since_watermark(spark, folder):
    """Processing-time watermark; an unreadable ingest time stays pending."""
    rows = table(spark, folder, "events").select("event_id", "event_type", "ts")
    ingested = rows.select("event_id", F.when(F.col("event_type") != "error", F.col("ts")).alias("ingested_at"))
    since = F.lit("2024-01-15 00:00:00").cast(dict(rows.dtypes)["ts"])
    return ops.pending(rows.select("event_id"), ingested, "event_id", since)


@query("pending_in_scope", "F11 H3", """
WITH scope AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'click')
SELECT event_id FROM events SEMI JOIN scope USING (user_id) WHERE event_type = 'error' OR ts > TIMESTAMP '2024-01-15 00:00:00'""")
def pending_in_scope(spark, folder):
    """Pending rows of the scope's materials; an unknown ingest time stays pending here too."""
    events = table(spark, folder, "events")
    scope = events.where("event_type = 'click'").select("user_id").distinct()
    rows = events.join(scope, "user_id", "left_semi").select("event_id", "event_type", "ts")
    ingested = rows.select("event_id", F.when(F.col("event_type") != "error", F.col("ts")).alias("ingested_at"))
    since = F.lit("2024-01-15 00:00:00").cast(dict(rows.dtypes)["ts"])
    return ops.pending(rows.select("event_id"), ingested, "event_id", since)


@query("upsert_last_wins", "K2 S4 H16", """
SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY 1""")
def upsert_last_wins(spark, folder):
    return ops.last_wins(table(spark, folder, "events").select("user_id", "event_type", "event_id"), "user_id", "event_id")


@query("upsert_first_wins", "K3", """
SELECT user_id, arg_min(event_type, event_id) AS event_type, min(event_id) AS event_id FROM events GROUP BY 1""")
def upsert_first_wins(spark, folder):
    return ops.first_wins(table(spark, folder, "events").select("user_id", "event_type", "event_id"), "user_id", "event_id")


@query("ingest_dedup", "R5 K10", """
SELECT sha256(text) AS file_hash, min(doc_id) AS material_id FROM documents
WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY 1""")
def ingest_dedup(spark, folder):
    skipped = table(spark, folder, "labels").where("toxic = 1").select("doc_id")
    rows = table(spark, folder, "documents").select("doc_id", content_hash(F.col("text")).alias("file_hash")).join(skipped, "doc_id", "left_anti")
    return rows.groupBy("file_hash").agg(F.min("doc_id").alias("material_id"))


MANIFEST = """
hashed AS (SELECT doc_id, lang, source, text, sha256(text) AS h FROM documents),
manifest AS (
  SELECT substr(h, 1, 12) AS material_id, max(h) AS file_hash, 'library/' || max(doc_id) AS path FROM hashed GROUP BY 1),
snap AS (
  SELECT CASE WHEN source = 'src3' THEN 'moved/' ELSE 'library/' END || doc_id AS path,
         CASE WHEN lang = 'de' THEN sha256(text || '!') ELSE h END AS file_hash
  FROM hashed WHERE source <> 'src5'
  UNION ALL SELECT 'web/' || page_id, sha256(html) FROM pages),
ignored AS (SELECT DISTINCT sha256(text) AS file_hash FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)"""
PLAN = """,
live AS (SELECT path, file_hash, substr(file_hash, 1, 12) AS material_id FROM snap WHERE file_hash NOT IN (SELECT file_hash FROM ignored)),
known AS (SELECT l.*, m.file_hash AS old_hash, m.material_id AS old_id FROM live l LEFT JOIN manifest m ON m.path = l.path),
arrived AS (
  SELECT CASE WHEN h.file_hash IS NOT NULL THEN 'move' ELSE 'add' END AS action, k.path, coalesce(h.material_id, k.material_id) AS material_id
  FROM known k LEFT JOIN (SELECT file_hash, max(material_id) AS material_id FROM manifest GROUP BY 1) h ON h.file_hash = k.file_hash WHERE old_id IS NULL),
gone AS (
  SELECT old_id AS material_id FROM known WHERE old_id IS NOT NULL AND old_hash <> file_hash
  UNION SELECT material_id FROM manifest WHERE path NOT IN (SELECT path FROM live))
SELECT 'update' AS action, path, material_id FROM known WHERE old_id IS NOT NULL AND old_hash <> file_hash
UNION ALL SELECT * FROM arrived
UNION ALL SELECT 'delete', '', material_id FROM gone WHERE material_id NOT IN (SELECT material_id FROM arrived)"""


def manifest_of(spark, folder):
    h = content_hash(F.col("text"))
    hashed = table(spark, folder, "documents").select("doc_id", h.alias("h"))
    return hashed.groupBy(F.substring("h", 1, 12).alias("material_id")).agg(
        F.max("h").alias("file_hash"), F.concat(F.lit("library/"), F.max("doc_id").cast("string")).alias("path"))


def snapshot_of(spark, folder):
    docs = table(spark, folder, "documents").where("source != 'src5'")
    where = F.when(F.col("source") == "src3", "moved/").otherwise("library/")
    body = F.when(F.col("lang") == "de", F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    files = docs.select(F.concat(where, F.col("doc_id").cast("string")).alias("path"), content_hash(body).alias("file_hash"))
    web = table(spark, folder, "pages").select(F.concat(F.lit("web/"), F.col("page_id").cast("string")).alias("path"), content_hash(F.col("html")).alias("file_hash"))
    return files.unionByName(web).withColumn("material_id", F.substring("file_hash", 1, 12))


def ignored_of(spark, folder):
    toxic = table(spark, folder, "labels").where("toxic = 1").select("doc_id")
    return table(spark, folder, "documents").join(toxic, "doc_id", "left_semi").select(content_hash(F.col("text")).alias("file_hash")).distinct()


@query("change_plan_full_outer", "R2 J28 R1", with_ctes(MANIFEST) + PLAN)
def change_plan_full_outer(spark, folder):
    return ops.change_plan(manifest_of(spark, folder), snapshot_of(spark, folder), ignored_of(spark, folder))


@query("prune_missing", "J29", with_ctes(MANIFEST) + """
SELECT material_id, path FROM manifest WHERE path NOT IN (SELECT path FROM snap)""")
def prune_missing(spark, folder):
    return manifest_of(spark, folder).join(snapshot_of(spark, folder).select("path"), "path", "left_anti").select("material_id", "path")


@query("cascade_delete_anti", "K8 H19", with_ctes(MEMBERSHIPS) + """,
gone AS (SELECT p_partkey AS material_id FROM part WHERE p_brand IN ('Brand#1', 'Brand#2', 'Brand#3')),
remaining AS (SELECT * FROM memberships WHERE material_id NOT IN (SELECT material_id FROM gone))
SELECT cluster_id, material_id FROM remaining WHERE cluster_id IN (SELECT cluster_id FROM remaining GROUP BY 1 HAVING count(*) >= 2)""")
def cascade_delete_anti(spark, folder):
    gone = table(spark, folder, "part").where("p_brand IN ('Brand#1', 'Brand#2', 'Brand#3')").select(F.col("p_partkey").alias("material_id"))
    return ops.cascade_delete(corpus.memberships(spark, folder), gone).select("cluster_id", "material_id")


@query("cascade_delete_small_clusters", "K8 H19", """
WITH m AS (SELECT DISTINCT l_orderkey AS cluster_id, l_partkey AS material_id FROM lineitem),
gone AS (SELECT p_partkey AS material_id FROM part WHERE p_type = 'ECONOMY'),
remaining AS (SELECT * FROM m WHERE material_id NOT IN (SELECT material_id FROM gone))
SELECT cluster_id, material_id FROM remaining WHERE cluster_id IN (SELECT cluster_id FROM remaining GROUP BY 1 HAVING count(*) >= 2)""")
def cascade_delete_small_clusters(spark, folder):
    rows = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("cluster_id"), F.col("l_partkey").alias("material_id")).distinct()
    gone = table(spark, folder, "part").where("p_type = 'ECONOMY'").select(F.col("p_partkey").alias("material_id"))
    return ops.cascade_delete(rows, gone).select("cluster_id", "material_id")


@query("latest_stage_time", "H10 H9", """
SELECT event_type, arg_max(event_id, ts) AS stamp_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS at_time, max(ts) > TIMESTAMP '2024-01-20 00:00:00' AS due
FROM events GROUP BY 1""")
def latest_stage_time(spark, folder):
    rows = table(spark, folder, "events")
    since = F.lit("2024-01-20 00:00:00").cast(dict(rows.dtypes)["ts"])
    return rows.groupBy("event_type").agg(
        F.max_by("event_id", "ts").alias("stamp_id"), F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("at_time"),
        (F.max("ts") > since).alias("due"))


@query("moved_scope_refresh", "P15", """
SELECT doc_id, lang AS domain, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE quality = 0) THEN '_general' ELSE source END AS collection,
  doc_id IN (SELECT doc_id FROM labels WHERE quality = 0) AS changed FROM documents""")
def moved_scope_refresh(spark, folder):
    entries = table(spark, folder, "labels").where("quality = 0").select("doc_id", F.lit("_general").alias("new_collection"))
    docs = table(spark, folder, "documents").select("doc_id", F.col("lang").alias("domain"), "source").join(entries, "doc_id", "left")
    value = F.coalesce("new_collection", "source")
    return docs.select("doc_id", "domain", text_or_empty(value).alias("collection"), (value != F.col("source")).alias("changed"))
