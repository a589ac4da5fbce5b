"""Stage gates, stamps, compact snapshots and the streaming change plan."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import functions as F

from lectern.functions.lists import content_hash, first_text, set_digest
from lectern.functions.names import collection_or_default, domain_or_default
from lectern.operators import incremental as ops
from lectern.operators.evidence import sample_per
from lectern.plans import corpus
from lectern.plans.corpus import CLUSTERS, CONCEPTS, MEMBERSHIPS, table, with_ctes
from lectern.plans.incremental import MANIFEST, PLAN, ignored_of, manifest_of, snapshot_of
from lectern.plans.registry import query
from lectern.sources import readers
from lectern.streaming.changes import resume


@query("concept_rows_sorted", "H1", with_ctes(CONCEPTS) + "SELECT concept_key, material_id, concept_name FROM concepts ORDER BY 1, 2")
def concept_rows_sorted(spark, folder):
    return corpus.concepts(spark, folder).select("concept_key", "material_id", "concept_name").orderBy("concept_key", "material_id")


@query("scope_defaults", "H2 A23", """
SELECT coalesce(nullif(trim(CASE WHEN lang = 'es' THEN ' ' ELSE lang END), ''), 'practice') AS domain,
       coalesce(nullif(trim(CASE WHEN source = 'src1' THEN '' ELSE source END), ''), '_general') AS collection, count(*) AS n FROM documents GROUP BY 1, 2""")
def scope_defaults(spark, folder):
    domain = F.when(F.col("lang") == "es", " ").otherwise(F.col("lang"))
    place = F.when(F.col("source") == "src1", "").otherwise(F.col("source"))
    return table(spark, folder, "documents").groupBy(
        domain_or_default(domain).alias("domain"), collection_or_default(place).alias("collection")).agg(F.count(F.lit(1)).alias("n"))


@query("compact_snapshots", "G13 H6 H33", with_ctes(CLUSTERS, MEMBERSHIPS) + """
SELECT c.cluster_id, c.canonical_name, m.material_id, n FROM (
  SELECT cluster_id, material_id, row_number() OVER (PARTITION BY cluster_id ORDER BY material_id) AS n FROM memberships) m
JOIN clusters c ON c.cluster_id = m.cluster_id WHERE n <= 3""")
def compact_snapshots(spark, folder):
    """A cluster's packet shows its first three references only."""
    few = sample_per(corpus.memberships(spark, folder), "cluster_id", 3, F.asc("material_id"))
    names = corpus.clusters(spark, folder).select("cluster_id", "canonical_name")
    return few.join(names, "cluster_id").select("cluster_id", "canonical_name", "material_id", F.col("rn").alias("n"))


@query("stage_eligibility", "H13", """
SELECT doc_id, lang <> 'es' AND source <> 'src2' AS figures, n_chars > 0 AS has_text, lang = 'es' OR n_chars < 40 AS visual FROM documents""")
def stage_eligibility(spark, folder):
    project = F.col("lang") == "es"
    return table(spark, folder, "documents").select(
        "doc_id", (~project & (F.col("source") != "src2")).alias("figures"), (F.col("n_chars") > 0).alias("has_text"),
        (project | (F.col("n_chars") < 40)).alias("visual"))


@query("manifest_counters", "H23 A26", """
WITH h AS (SELECT sha256(doc_id || ':' || sha256(text)) AS h FROM documents)
SELECT count(*) AS materials, sha256(concat_ws(':',
  CAST(sum(('0x' || substr(h, 1, 12))::BIGINT) AS VARCHAR), CAST(sum(('0x' || substr(h, 13, 12))::BIGINT) AS VARCHAR),
  CAST(sum(('0x' || substr(h, 25, 12))::BIGINT) AS VARCHAR), CAST(sum(('0x' || substr(h, 37, 12))::BIGINT) AS VARCHAR), CAST(count(*) AS VARCHAR))) AS digest FROM h""")
def manifest_counters(spark, folder):
    member = F.concat(F.col("doc_id").cast("string"), F.lit(":"), content_hash(F.col("text")))
    h = table(spark, folder, "documents").select(F.sha2(member, 256).alias("h"))
    return h.agg(F.count(F.lit(1)).alias("materials"), set_digest(F.col("h")).alias("digest"))


@query("index_gate", "R8 R9 R7", """
SELECT CASE WHEN (SELECT count(*) FROM documents) <> (SELECT count(*) FROM documents WHERE source <> 'src5') THEN 'material count differs' ELSE '' END AS reason, true AS stale""")
def index_gate(spark, folder):
    docs = table(spark, folder, "documents")
    h = docs.select("source", content_hash(F.col("text")).alias("h"))
    stamp = h.where("source != 'src5'").agg(
        F.count(F.lit(1)).alias("materials"), set_digest(F.col("h")).alias("digest"),
        F.lit("2024-01-10 00:00:00").try_cast("timestamp").alias("indexed_at"))
    newest = table(spark, folder, "events").agg(F.max(F.col("ts").cast("timestamp"))).scalar()
    rows = docs.agg(F.count(F.lit(1))).scalar()
    return ops.index_gate(stamp, rows, newest, h.agg(set_digest(F.col("h"))).scalar())


@query("resume_work", "R11 H22", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_work(spark, folder):
    return resume(table(spark, folder, "labels"), table(spark, folder, "documents").select("doc_id"), "doc_id")


@query("fingerprint_union", "H32", """
SELECT user_id, arg_max(event_type, event_id) AS fingerprint FROM events WHERE event_type <> 'view' GROUP BY 1""")
def fingerprint_union(spark, folder):
    stamps = table(spark, folder, "events").select(
        "user_id", F.when(F.col("event_type") == "view", "").otherwise(F.col("event_type")).alias("fingerprint"), "event_id")
    return ops.later_map_wins(stamps, "user_id", "fingerprint", "event_id")


@query("ignored_hashes", "H44", "SELECT DISTINCT sha256(text) AS file_hash FROM documents SEMI JOIN (SELECT doc_id FROM labels WHERE toxic = 1) USING (doc_id)")
def ignored_hashes(spark, folder):
    return ignored_of(spark, folder)


@query("bridge_reflection_due", "A13", """
SELECT n_nationkey AS bridge_id FROM nation LEFT JOIN (SELECT s_nationkey, count(*) AS n, max(s_acctbal) AS top FROM supplier GROUP BY 1) ON s_nationkey = n_nationkey
WHERE coalesce(n, 0) = 0 OR n < 4 OR top < 5000""")
def bridge_reflection_due(spark, folder):
    """Due when nothing was written, the members changed or the stamp differs."""
    facts = table(spark, folder, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("n"), F.max("s_acctbal").alias("top"))
    joined = table(spark, folder, "nation").select("n_nationkey").join(facts, "n_nationkey", "left")
    return joined.where((F.coalesce("n", F.lit(0)) == 0) | (F.col("n") < 4) | (F.col("top") < 5000)).select(F.col("n_nationkey").alias("bridge_id"))


@query("tolerant_jsonl", "S5", "SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events WHERE event_type <> 'error'")
def tolerant_jsonl(spark, folder):
    """Malformed and blank lines drop out, the rest is read."""
    line = F.when(F.col("event_type") == "error", F.concat(F.lit("{oops "), "props")).otherwise(F.col("props"))
    parsed = table(spark, folder, "events").select("event_id", F.try_parse_json(line).alias("v")).where("v IS NOT NULL")
    return parsed.select("event_id", F.try_variant_get("v", "$.k", "bigint").alias("k"))


@query("read_only_sql", "S18", "SELECT lang, count(*) AS n FROM documents WHERE n_chars > 100 GROUP BY lang")
def read_only_sql(spark, folder):
    return readers.read_only_sql(
        spark, "SELECT lang, count(*) AS n FROM {materials} WHERE n_chars > 100 GROUP BY lang", materials=table(spark, folder, "documents"))


@query("scope_from_members", "S20 S21", with_ctes(CLUSTERS) + """
SELECT bridge_id, CASE WHEN min(domain) = max(domain) THEN min(domain) ELSE '' END AS domain FROM (
  SELECT l_orderkey AS bridge_id, domain FROM lineitem JOIN clusters ON cluster_id = l_suppkey) GROUP BY 1""")
def scope_from_members(spark, folder):
    """A bridge without a domain takes its members' when they all agree."""
    pairs = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("bridge_id"), F.col("l_suppkey").alias("cluster_id"))
    joined = pairs.join(corpus.clusters(spark, folder).select("cluster_id", "domain"), "cluster_id")
    return joined.groupBy("bridge_id").agg(
        F.when(F.min("domain") == F.max("domain"), F.min("domain")).otherwise("").alias("domain"))


@query("context_requests", "H26 O13", """
SELECT user_id, event_id, least(greatest(CAST(value AS BIGINT), 1), 8) AS row_limit, n FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events WHERE event_type IN ('view', 'click')) WHERE n <= 4""")
def context_requests(spark, folder):
    """Known tools only, at most four requests per pass, limits clamped to 1..8."""
    known = table(spark, folder, "events").where(F.col("event_type").isin("view", "click"))
    first = sample_per(known, "user_id", 4, F.asc("event_id"))
    # halves go to the even number, as a cast does in SQL
    limit = F.least(F.greatest(F.rint("value").cast("bigint"), F.lit(1)), F.lit(8)).cast("bigint")
    return first.select("user_id", "event_id", limit.alias("row_limit"), F.col("rn").alias("n"))


@query("project_state_latest", "H9", """
SELECT user_id AS project_id, arg_max(event_type, event_id) AS stage, arg_max(event_id, event_id) AS revision,
  count(*) AS revisions FROM events WHERE event_type <> 'error' GROUP BY 1""")
def project_state_latest(spark, folder):
    """Append-only log: refused deltas are skipped, the last accepted one rules."""
    log = table(spark, folder, "events").where("event_type != 'error'")
    return log.groupBy(F.col("user_id").alias("project_id")).agg(
        F.max_by(first_text(F.col("event_type")), "event_id").alias("stage"), F.max("event_id").alias("revision"), F.count(F.lit(1)).alias("revisions"))


@query("stream_change_plan", "R3 R4 R1 R2", with_ctes(MANIFEST) + PLAN)
def stream_change_plan(spark, folder):
    """The change plan made by a stream that drains the arrived files.

    Each batch compares the whole snapshot with the manifest and writes its
    plan under the batch id in the shared checkpoint folder.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="lectern-stream-")
    base = os.path.join(shared, f"change-plan-{uuid.uuid4().hex}")
    docs = table(spark, folder, "documents")
    # a pattern matches a single file and a folder of part files alike; a plain file is refused as a stream's path
    arrivals = spark.readStream.schema(docs.schema).parquet(f"{folder}/[d]ocuments.parquet").select("doc_id")

    def plan(batch, batch_id):
        actions = ops.change_plan(manifest_of(spark, folder), snapshot_of(spark, folder), ignored_of(spark, folder))
        actions.write.mode("overwrite").parquet(f"{base}/plans/batch={batch_id}")

    running = arrivals.writeStream.foreachBatch(plan).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    running.awaitTermination()
    plans = spark.read.parquet(f"{base}/plans")
    last = plans.agg(F.max("batch")).scalar()  # each batch plans against the whole library: the last one holds
    return plans.where(F.col("batch") == last).select("action", "path", "material_id")
