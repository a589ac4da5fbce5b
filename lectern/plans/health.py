"""Deterministic health checks and their report."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions.lists import content_hash
from lectern.functions.names import material_path
from lectern.functions.text import first_line
from lectern.operators import quality as Q
from lectern.plans.corpus import table, with_ctes
from lectern.plans.linking import PAGES, broken_links_of
from lectern.plans.registry import query

MISSING = """
missing AS (
  SELECT d.doc_id, array_to_string(list_filter([
    CASE WHEN trim(string_split(text, chr(10))[1]) = '' THEN 'title' END, CASE WHEN coalesce(lang, '') = '' THEN 'domain' END,
    CASE WHEN l.quality IS NULL THEN 'raw_document_type' END], lambda x: x IS NOT NULL), ', ') AS fields
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""


def _missing(spark, folder):
    labels = table(spark, folder, "labels").select("doc_id", "quality")
    docs = table(spark, folder, "documents").select("doc_id", "lang", first_line(F.col("text")).alias("title"))
    return docs.join(labels, "doc_id", "left").select("doc_id", Q.missing_fields(
        {"title": F.col("title"), "domain": F.col("lang"), "raw_document_type": F.col("quality")}).alias("fields")).where("fields != ''")


def _duplicate_groups(spark, folder):
    hashed = table(spark, folder, "documents").select("doc_id", content_hash(F.col("text")).alias("h"))
    return hashed.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("doc_id")).where("n > 1")


def _orphans(spark, folder):
    known = table(spark, folder, "documents").select(F.col("doc_id").alias("material_id"))
    extracted = table(spark, folder, "pages").select(F.col("page_id").alias("material_id")).unionByName(
        table(spark, folder, "part").select(F.col("p_partkey").alias("material_id")))
    return Q.absent(extracted, known, "material_id")


def _missing_pages(spark, folder):
    expected = table(spark, folder, "documents").select(
        "doc_id", material_path(F.col("lang"), F.col("source"), F.col("doc_id")).alias("path"))
    written = table(spark, folder, "documents").join(table(spark, folder, "labels").select("doc_id"), "doc_id", "left_semi").select(
        material_path(F.col("lang"), F.col("source"), F.col("doc_id")).alias("path"))
    return Q.absent(expected, written, "path")


ORPHANS = """
orphans AS (
  SELECT material_id FROM (SELECT page_id AS material_id FROM pages UNION ALL SELECT p_partkey FROM part)
  WHERE material_id NOT IN (SELECT doc_id FROM documents))"""
DUPES = """
dupes AS (SELECT sha256(text) AS h, count(*) AS n, min(doc_id) AS doc_id FROM documents GROUP BY 1 HAVING count(*) > 1)"""
UNWRITTEN = """
unwritten AS (
  SELECT doc_id, 'wiki/' || lang || '/' || source || '/' || doc_id || '.md' AS path FROM documents
  WHERE doc_id NOT IN (SELECT doc_id FROM labels))"""
BROKEN = """
broken AS (
  SELECT page_id, 'wiki/' || regexp_replace(target, '^\\.\\./|#.*$', '', 'g') AS resolved FROM links
  WHERE target <> '' AND 'wiki/' || regexp_replace(target, '^\\.\\./|#.*$', '', 'g')
    NOT IN (SELECT regexp_extract(path, '^(wiki/[a-z]+)/', 1) || '.md' FROM wiki))"""
STALE = """
stale AS (
  SELECT doc_id FROM documents LEFT JOIN (
    SELECT doc_id AS k, substr(sha256(lang || chr(31) || CASE WHEN n_chars > 2000 THEN 'old' ELSE CAST(n_chars AS VARCHAR) END), 1, 16) AS fp
    FROM documents WHERE source <> 'src5') ON k = doc_id
  WHERE fp IS NULL OR fp <> substr(sha256(lang || chr(31) || CAST(n_chars AS VARCHAR)), 1, 16))"""


def _stale(spark, folder):
    from lectern.functions.lists import canonical_hash
    from lectern.operators.incremental import stale_rows

    docs = table(spark, folder, "documents").select("doc_id", "lang", "source", "n_chars")
    current = docs.select("doc_id", canonical_hash(F.col("lang"), F.col("n_chars")).alias("input_fingerprint"))
    old_size = F.when(F.col("n_chars") > 2000, "old").otherwise(F.col("n_chars").cast("string"))
    stored = docs.where("source != 'src5'").select("doc_id", canonical_hash(F.col("lang"), old_size).alias("input_fingerprint"))
    return stale_rows(current, stored, "doc_id", ["input_fingerprint"])


@query("missing_fields", "F13", with_ctes(MISSING) + "SELECT * FROM missing WHERE fields <> ''")
def missing_fields(spark, folder):
    return _missing(spark, folder)


@query("orphans_anti", "J29", with_ctes(ORPHANS) + "SELECT * FROM orphans")
def orphans_anti(spark, folder):
    return _orphans(spark, folder)


@query("missing_pages_anti", "J29 U7", with_ctes(UNWRITTEN) + "SELECT * FROM unwritten")
def missing_pages_anti(spark, folder):
    return _missing_pages(spark, folder).select("doc_id", "path")


@query("stale_enrichment", "G16 G17 H12", with_ctes(STALE) + "SELECT * FROM stale")
def stale_enrichment(spark, folder):
    return _stale(spark, folder).select("doc_id")


REPORT = with_ctes(MISSING, ORPHANS, DUPES, UNWRITTEN, PAGES, BROKEN, STALE) + """,
issues AS (
  SELECT 'missing_metadata' AS issue, 'high' AS severity, CAST(doc_id AS VARCHAR) AS material_id, 'Missing fields: ' || fields AS detail FROM missing WHERE fields <> ''
  UNION ALL SELECT 'orphaned_material', 'medium', CAST(material_id AS VARCHAR), '' FROM orphans
  UNION ALL SELECT 'duplicate_material', 'medium', CAST(doc_id AS VARCHAR), h FROM dupes
  UNION ALL SELECT 'missing_compiled_page', 'high', CAST(doc_id AS VARCHAR), path FROM unwritten
  UNION ALL SELECT 'broken_link', 'high', CAST(page_id AS VARCHAR), resolved FROM broken
  UNION ALL SELECT 'stale_enrichment', 'medium', CAST(doc_id AS VARCHAR), '' FROM stale)"""


def _issues(spark, folder):
    none = F.lit("")
    return Q.report([
        Q.issue(_missing(spark, folder), "missing_metadata", "high", F.col("doc_id"), F.concat(F.lit("Missing fields: "), "fields")),
        Q.issue(_orphans(spark, folder), "orphaned_material", "medium", F.col("material_id"), none),
        Q.issue(_duplicate_groups(spark, folder), "duplicate_material", "medium", F.col("doc_id"), F.col("h")),
        Q.issue(_missing_pages(spark, folder), "missing_compiled_page", "high", F.col("doc_id"), F.col("path")),
        Q.issue(broken_links_of(spark, folder), "broken_link", "high", F.col("page_id"), F.col("resolved")),
        Q.issue(_stale(spark, folder), "stale_enrichment", "medium", F.col("doc_id"), none),
    ])


@query("health_issues", "G15", REPORT + "SELECT * FROM issues")
def health_issues(spark, folder):
    return _issues(spark, folder)


@query("health_report", "G15 A13 H29", REPORT + "SELECT issue, severity, count(*) AS n FROM issues GROUP BY 1, 2")
def health_report(spark, folder):
    return Q.severity_totals(_issues(spark, folder))


@query("severity_order", "O5", """
SELECT event_id, event_type FROM events
ORDER BY CASE event_type WHEN 'error' THEN 0 WHEN 'click' THEN 1 ELSE 2 END, event_id""")
def severity_order(spark, folder):
    level = F.when(F.col("event_type") == "error", 0).when(F.col("event_type") == "click", 1).otherwise(2)
    return table(spark, folder, "events").select("event_id", "event_type").orderBy(level, "event_id")
