"""Wiki links: extraction, resolution and the pages they reach."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import names as N
from lectern.functions.text import bind
from lectern.plans.corpus import table, with_ctes
from lectern.plans.registry import query

PAGE_PATH = "'wiki/' || coalesce(nullif(regexp_extract(url, '//[^/]*/([a-z]+)/', 1), ''), 'misc') || '/' || page_id || '.md'"
PAGES = rf"""
wiki AS (
  SELECT page_id, {PAGE_PATH} AS path,
         regexp_replace(html, '<a href="/([^"]*)">([^<]*)</a>', '[\2](../\1.md#top)', 'g') AS md FROM pages),
links AS (SELECT page_id, path, unnest(list_transform(regexp_extract_all(md, '\[[^\]]+\]\(([^)]+)\)', 1), lambda t: trim(t))) AS target FROM wiki)"""


def _pages(spark, folder):
    lang = F.coalesce(F.nullif(F.regexp_extract("url", "//[^/]*/([a-z]+)/", 1), F.lit("")), F.lit("misc"))
    md = F.regexp_replace("html", '<a href="/([^"]*)">([^<]*)</a>', "[$2](../$1.md#top)")
    return table(spark, folder, "pages").select(
        "page_id", F.concat(F.lit("wiki/"), lang, F.lit("/"), F.col("page_id").cast("string"), F.lit(".md")).alias("path"), md.alias("md"))


def _links(spark, folder):
    return _pages(spark, folder).select("page_id", "path", F.explode(N.markdown_links(F.col("md"))).alias("target"))


def broken_links_of(spark, folder):
    resolved = _links(spark, folder).withColumn("resolved", N.resolve_link(F.col("path"), F.col("target"))).where("resolved IS NOT NULL")
    live = _pages(spark, folder).select(F.concat(F.regexp_extract("path", "^(wiki/[a-z]+)/", 1), F.lit(".md")).alias("resolved"))
    return resolved.join(live, "resolved", "left_anti")


@query("page_links", "X22", with_ctes(PAGES) + "SELECT page_id, target FROM links WHERE target <> ''")
def page_links(spark, folder):
    return _links(spark, folder).select("page_id", "target")


@query("links_resolved", "X23 F20", with_ctes(PAGES) + "SELECT page_id, target, 'wiki/' || regexp_replace(target, '^\\.\\./|#.*$', '', 'g') AS resolved FROM links WHERE target <> ''")
def links_resolved(spark, folder):
    return _links(spark, folder).select("page_id", "target", N.resolve_link(F.col("path"), F.col("target")).alias("resolved"))


@query("broken_links_anti", "J30", with_ctes(PAGES) + """,
r AS (SELECT page_id, 'wiki/' || regexp_replace(target, '^\\.\\./|#.*$', '', 'g') AS resolved FROM links WHERE target <> '')
SELECT page_id, resolved FROM r WHERE resolved NOT IN (SELECT regexp_extract(path, '^(wiki/[a-z]+)/', 1) || '.md' FROM wiki)""")
def broken_links_anti(spark, folder):
    return broken_links_of(spark, folder).select("page_id", "resolved")


@query("relative_links", "X24", """
SELECT doc_id, CASE WHEN lang = 'en' THEN '../' || source || '/' || doc_id || '.md' ELSE '../../' || lang || '/' || source || '/' || doc_id || '.md' END AS link
FROM documents WHERE NOT (lang = 'en' AND source = 'src1') UNION ALL
SELECT doc_id, doc_id || '.md' FROM documents WHERE lang = 'en' AND source = 'src1'""")
def relative_links(spark, folder):
    here = F.lit("wiki/en/src1/_index.md")
    path = N.material_path(F.col("lang"), F.col("source"), F.col("doc_id"))
    return table(spark, folder, "documents").select("doc_id", N.relative_link(here, path).alias("link"))


@query("concept_page_materials", "J32", """
SELECT doc_id AS page_id, doc_id AS material_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)""")
def concept_page_materials(spark, folder):
    """Materials linked from a page: only four-segment wiki paths count."""
    docs = table(spark, folder, "documents").select("doc_id", "lang", "source")
    deep = F.concat(F.lit("[m](../../"), "lang", F.lit("/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md)"))
    body = F.concat(deep, F.lit(" and [index](../_index.md) again "), deep)
    page = F.concat(F.lit("wiki/"), "lang", F.lit("/concepts/"), F.col("doc_id").cast("string"), F.lit(".md"))
    found = docs.select(F.col("doc_id").alias("page_id"), page.alias("path"), F.explode(F.array_distinct(N.markdown_links(body))).alias("target"))
    resolved = found.select("page_id", bind(N.resolve_link(F.col("path"), F.col("target")), lambda r: F.split(r, "/")).alias("seg"))
    ids = resolved.where(F.size("seg") == 4).select("page_id", F.regexp_extract(F.element_at("seg", 4), r"^(\d+)\.md$", 1).try_cast("bigint").alias("material_id"))
    known = table(spark, folder, "labels").select(F.col("doc_id").alias("material_id"))
    return ids.join(known, "material_id", "left_semi").select("page_id", "material_id")


@query("glossary_page_entries", "H40 S19", r"""
SELECT page_id, trim(label) AS label FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href="/[^"]*">([^<]*)</a>', 1)) AS label FROM pages)
WHERE starts_with(lower(label), 'e')""")
def glossary_page_entries(spark, folder):
    labels = F.regexp_extract_all("html", F.lit('<a href="/[^"]*">([^<]*)</a>'), F.lit(1))
    return table(spark, folder, "pages").select("page_id", F.explode(labels).alias("label")).where(F.lower("label").startswith("e")).select(
        "page_id", F.trim("label").alias("label"))
