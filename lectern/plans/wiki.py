"""Which pages a compiled wiki should have, and which of its pages nothing asks for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.fixed import SHARED_PAGES
from lectern.functions.names import concept_path, material_path, slugify
from lectern.plans import corpus
from lectern.plans.corpus import CLUSTERS, table, with_ctes
from lectern.plans.registry import query

PROJECTS = "es"  # the domain whose collections are project dossiers, without a concept index
EXPECTED = f"""
expected AS (
  SELECT 'material' AS kind, 'wiki/' || lang || '/' || source || '/' || doc_id || '.md' AS path FROM documents
  UNION SELECT 'collection', 'wiki/' || lang || '/' || source || '/_index.md' FROM documents
  UNION SELECT 'collection', 'wiki/' || lang || '/' || source || '/concepts/_index.md' FROM documents WHERE lang <> '{PROJECTS}'
  UNION SELECT 'domain', 'wiki/' || lang || '/_index.md' FROM documents
  UNION SELECT 'domain', 'wiki/' || domain || '/bridge-concepts/_index.md' FROM clusters
  UNION SELECT 'concept', 'wiki/' || domain || '/' || collection || '/concepts/' || regexp_replace(lower(canonical_name), '[^a-z0-9-]+', '', 'g') || '.md' FROM clusters
  UNION SELECT 'shared', unnest([{", ".join(f"'{p}'" for p in SHARED_PAGES)}])),
written AS (
  SELECT path FROM expected WHERE path NOT LIKE '%/src3/%'
  UNION ALL SELECT 'wiki/' || lang || '/' || source || '/gone-' || doc_id || '.md' FROM documents WHERE doc_id % 17 = 0)"""


def expected(spark, folder) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "lang", "source")
    scopes = docs.select("lang", "source").distinct()
    clusters = corpus.clusters(spark, folder).select("domain", "collection", "canonical_name")

    def pages(rows: DataFrame, kind: str, path) -> DataFrame:
        return rows.select(F.lit(kind).alias("kind"), path.alias("path"))

    under = F.concat(F.lit("wiki/"), F.col("lang"), F.lit("/"), F.col("source"))
    shared = spark.range(1).select(F.explode(F.array(*map(F.lit, SHARED_PAGES))).alias("page"))
    return (
        pages(docs, "material", material_path(F.col("lang"), F.col("source"), F.col("doc_id")))
        .union(pages(scopes, "collection", F.concat(under, F.lit("/_index.md"))))
        .union(pages(scopes.where(F.col("lang") != PROJECTS), "collection", F.concat(under, F.lit("/concepts/_index.md"))))
        .union(pages(scopes.select("lang").distinct(), "domain", F.concat(F.lit("wiki/"), F.col("lang"), F.lit("/_index.md"))))
        .union(pages(clusters.select("domain").distinct(), "domain", F.concat(F.lit("wiki/"), F.col("domain"), F.lit("/bridge-concepts/_index.md"))))
        .union(pages(clusters, "concept", concept_path(F.col("domain"), F.col("collection"), slugify(F.col("canonical_name")))).distinct())
        .union(pages(shared, "shared", F.col("page"))))


@query("expected_pages", "U7", with_ctes(CLUSTERS, EXPECTED) + "SELECT kind, path FROM expected")
def expected_pages(spark, folder):
    """Pages of materials, of collection and domain indexes, of concepts, and the shared ones."""
    return expected(spark, folder)


@query("orphaned_pages", "K11 G15", with_ctes(CLUSTERS, EXPECTED) + """
SELECT 'orphaned_wiki_page' AS issue, 'medium' AS severity, path FROM written WHERE path NOT IN (SELECT path FROM expected)""")
def orphaned_pages(spark, folder):
    """Written pages that no material, concept or index asks for."""
    gone = table(spark, folder, "documents").where("doc_id % 17 = 0").select(
        F.concat(F.lit("wiki/"), F.col("lang"), F.lit("/"), F.col("source"), F.lit("/gone-"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"))
    wanted = expected(spark, folder).select("path")
    written = wanted.where("path NOT LIKE '%/src3/%'").union(gone)
    return written.join(wanted, "path", "left_anti").select(
        F.lit("orphaned_wiki_page").alias("issue"), F.lit("medium").alias("severity"), "path")


@query("unwritten_pages", "J29 G15", with_ctes(CLUSTERS, EXPECTED) + """
SELECT 'missing_compiled_page' AS issue, kind, path FROM expected WHERE path NOT IN (SELECT path FROM written)""")
def unwritten_pages(spark, folder):
    """Expected pages of every kind that were not written."""
    wanted = expected(spark, folder)
    written = wanted.where("path NOT LIKE '%/src3/%'").select("path")
    return wanted.join(written, "path", "left_anti").select(F.lit("missing_compiled_page").alias("issue"), "kind", "path")
