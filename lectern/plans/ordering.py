"""Sorted listings, filters and point reads."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions.fixed import PROJECT_PHASES
from lectern.operators.evidence import sample_per
from lectern.plans import corpus
from lectern.plans.corpus import ANNOTATIONS, CHUNKS, CLUSTERS, FIGURES, table, with_ctes
from lectern.plans.registry import query


@query("recent_by_position", "O2", "SELECT doc_id, lang FROM documents WHERE lang = 'en' ORDER BY doc_id DESC LIMIT 10")
def recent_by_position(spark, folder):
    """Recent means last in manifest order, not latest ingest time."""
    return table(spark, folder, "documents").where("lang = 'en'").select("doc_id", "lang").orderBy(F.desc("doc_id")).limit(10)


@query("recent_by_ingest_time", "O8", """
SELECT event_type, event_id, n FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) AS n FROM events) WHERE n <= 10""")
def recent_by_ingest_time(spark, folder):
    rows = table(spark, folder, "events").select("event_type", "event_id", "ts")
    return sample_per(rows, "event_type", 10, F.desc("ts"), F.asc("event_id")).select("event_type", "event_id", F.col("rn").alias("n"))


@query("random_figures", "J15", None)
def random_figures(spark, folder):
    """Seeded sample of figures that have an image."""
    rows = corpus.figures(spark, folder).where("image_path != ''").select("material_id", "figure_id", "image_path")
    return rows.orderBy(F.rand(7)).limit(20)


@query("members_by_year", "O9", """
SELECT o_orderstatus AS collection, o_orderkey, year(o_orderdate) AS year FROM orders ORDER BY o_orderstatus, year DESC, o_orderkey""")
def members_by_year(spark, folder):
    return table(spark, folder, "orders").select(F.col("o_orderstatus").alias("collection"), "o_orderkey", F.year("o_orderdate").cast("bigint").alias("year")).orderBy(
        "collection", F.desc("year"), "o_orderkey")


@query("smallest_first", "O10", "SELECT doc_id, CAST(strlen(text) AS BIGINT) AS bytes FROM documents ORDER BY bytes, doc_id")
def smallest_first(spark, folder):
    return table(spark, folder, "documents").select("doc_id", F.octet_length("text").cast("bigint").alias("bytes")).orderBy("bytes", "doc_id")


@query("bridges_by_folded_name", "O6", with_ctes(CLUSTERS) + "SELECT cluster_id, canonical_name FROM clusters ORDER BY lower(canonical_name), cluster_id")
def bridges_by_folded_name(spark, folder):
    return corpus.clusters(spark, folder).select("cluster_id", "canonical_name").orderBy(F.lower("canonical_name"), "cluster_id")


@query("materials_of_collection", "O12", "SELECT doc_id FROM documents WHERE lang = 'en' AND source = 'src4' ORDER BY doc_id")
def materials_of_collection(spark, folder):
    return table(spark, folder, "documents").where("lang = 'en' AND source = 'src4'").select("doc_id").orderBy("doc_id")


@query("annotations_of_material", "F7", with_ctes(ANNOTATIONS) + "SELECT annotation_id, page FROM annotations WHERE material_id = 3 AND lower(type) = 'assistant'")
def annotations_of_material(spark, folder):
    return corpus.annotations(spark, folder).where((F.col("material_id") == 3) & (F.lower("type") == "ASSISTANT".lower())).select("annotation_id", "page")


@query("figures_by_type", "F8", with_ctes(FIGURES) + "SELECT material_id, figure_id FROM figures WHERE lower(visual_type) = 'photo'")
def figures_by_type(spark, folder):
    return corpus.figures(spark, folder).where(F.lower("visual_type") == "photo").select("material_id", "figure_id")


@query("chunk_by_id", "F9", with_ctes(CHUNKS) + "SELECT material_id, chunk_id, text FROM chunks WHERE material_id = 5 AND chunk_id = 'chk_00001'")
def chunk_by_id(spark, folder):
    return corpus.chunks(spark, folder).where("material_id = 5 AND chunk_id = 'chk_00001'").select("material_id", "chunk_id", "text")


@query("chunks_compact", "P9", with_ctes(CHUNKS) + "SELECT chunk_id, emphasized, length(text) AS chars FROM chunks WHERE material_id = 5")
def chunks_compact(spark, folder):
    return corpus.chunks(spark, folder).where("material_id = 5").select("chunk_id", "emphasized", F.length("text").cast("bigint").alias("chars"))


@query("open_notes", "F17", """
SELECT event_id, CASE WHEN event_type = 'view' THEN 'incorporated' ELSE 'open' END AS status FROM events WHERE event_type <> 'error'""")
def open_notes(spark, folder):
    """Deleted notes are left out; open ones other than strategy are incorporated."""
    notes = table(spark, folder, "events").where("event_type != 'error'")
    return notes.select("event_id", F.when(F.col("event_type") == "view", "incorporated").otherwise("open").alias("status"))


@query("project_groups", "A24 H39", """
WITH p(phase, ord) AS (VALUES ('lead', 0), ('schematic_design', 1), ('basic_project', 2), ('execution_project', 3), ('construction', 4), ('handover', 5)),
o AS (SELECT o_orderstatus AS kind, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'lead' WHEN '2' THEN 'schematic_design' WHEN '3' THEN 'basic_project'
  WHEN '4' THEN 'execution_project' ELSE 'construction' END AS phase FROM orders)
SELECT kind, phase, CASE WHEN ord < 2 THEN 'done' WHEN ord = 2 THEN 'active' ELSE 'pending' END AS state, count(*) AS n
FROM o JOIN p USING (phase) GROUP BY kind, phase, ord ORDER BY kind, ord""")
def project_groups(spark, folder):
    phases = F.array(*[F.lit(p) for p in PROJECT_PHASES])
    index = F.substring("o_orderpriority", 1, 1).cast("int") - 1
    grouped = table(spark, folder, "orders").groupBy(F.col("o_orderstatus").alias("kind"), index.alias("ord")).agg(F.count(F.lit(1)).alias("n"))
    state = F.when(F.col("ord") < 2, "done").when(F.col("ord") == 2, "active").otherwise("pending")
    return grouped.orderBy("kind", "ord").select("kind", F.get(phases, F.col("ord")).alias("phase"), state.alias("state"), "n")
