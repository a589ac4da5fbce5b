"""Library files, figures and the inverted index."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import figures as G
from lectern.functions.fixed import SCAN_ARTIFACT_PHRASES
from lectern.functions.text import bind
from lectern.operators import postings
from lectern.operators.ranking import best
from lectern.plans.corpus import table, with_ctes
from lectern.plans.registry import query
from lectern.plans.search import bm25_cte
from lectern.session import rounded
from lectern.sources import paths, readers

FILES = """
files AS (
  SELECT doc_id, CASE WHEN lang = 'en' THEN 'Research/' WHEN lang = 'fr' THEN 'practice/' ELSE '' END ||
    CASE WHEN source = 'src3' THEN 'Previos versions/' WHEN source = 'src4' THEN 'scans/' WHEN source = 'src5' THEN '' ELSE source || '/' END ||
    CASE WHEN source = 'src6' THEN 'site_page_' ELSE 'file_' END || doc_id ||
    CASE WHEN lang = 'en' THEN '.PDF' WHEN lang = 'fr' THEN '.png' WHEN lang = 'de' THEN '.md' ELSE '.xyz' END AS path FROM documents)"""


def _files(spark, folder):
    lang, source = F.col("lang"), F.col("source")
    top = F.when(lang == "en", "Research/").when(lang == "fr", "practice/").otherwise("")
    sub = F.when(source == "src3", "Previos versions/").when(source == "src4", "scans/").when(source == "src5", "").otherwise(F.concat(source, F.lit("/")))
    name = F.when(source == "src6", "site_page_").otherwise("file_")
    ext = F.when(lang == "en", ".PDF").when(lang == "fr", ".png").when(lang == "de", ".md").otherwise(".xyz")
    return table(spark, folder, "documents").select("doc_id", F.concat(top, sub, name, F.col("doc_id").cast("string"), ext).alias("path"))


@query("file_types", "S2", with_ctes(FILES) + """
SELECT doc_id, CASE WHEN path LIKE '%.PDF' THEN 'pdf' WHEN path LIKE '%.png' THEN
  CASE WHEN contains(path, 'scans/') OR contains(path, 'site_page_') THEN 'scanned_document' ELSE 'image' END
  WHEN path LIKE '%.md' THEN 'markdown' ELSE 'unknown' END AS file_type FROM files""")
def file_types(spark, folder):
    return _files(spark, folder).select("doc_id", paths.file_type(F.col("path")).alias("file_type"))


@query("path_scopes", "S3", with_ctes(FILES) + """
SELECT doc_id, CASE WHEN starts_with(path, 'Research/') THEN 'research' WHEN starts_with(path, 'practice/') THEN 'practice' ELSE '' END AS domain,
  CASE WHEN starts_with(path, 'Research/') OR starts_with(path, 'practice/')
    THEN CASE WHEN len(string_split(path, '/')) <= 2 THEN '_general' ELSE string_split(path, '/')[2] END
    ELSE CASE WHEN len(string_split(path, '/')) <= 1 THEN '_general' ELSE string_split(path, '/')[1] END END AS collection FROM files""")
def path_scopes(spark, folder):
    path = F.col("path")
    return _files(spark, folder).select("doc_id", paths.domain(path).alias("domain"), paths.collection(path).alias("collection"))


@query("library_scan", "S1 X44", with_ctes(FILES) + """
SELECT doc_id, path FROM files WHERE regexp_matches(lower(path), '\\.(pdf|png)$') AND NOT contains(lower(path), 'previos') ORDER BY path""")
def library_scan(spark, folder):
    ignored = paths.extension_list([" .MD ", "md"])
    return _files(spark, folder).where(paths.supported(F.col("path"), ignored)).orderBy("path")


@query("decoded_text", "S8", "SELECT doc_id, text || chr(10) || chr(10) || 'end' AS text FROM documents")
def decoded_text(spark, folder):
    raw = F.concat("text", F.lit("\r\n\r"), F.lit("e\u0000nd"))
    return table(spark, folder, "documents").select("doc_id", readers.clean_text(raw).alias("text"))


@query("markdown_sections", "S9", r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
m AS (SELECT doc_id, i, CASE WHEN length(raw) > 200 THEN '## ' || raw ELSE raw END AS line, length(raw) > 200 AND regexp_matches(raw, '^\s*\S') AS head, raw FROM l
  UNION ALL SELECT doc_id, 1000000, '```' || chr(10) || '# not a heading' || chr(10) || '```', false, '' FROM documents),
s AS (SELECT *, sum(CASE WHEN head THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS sec FROM m),
g AS (SELECT doc_id, sec, coalesce(max(CASE WHEN head THEN trim(raw) END), '') AS heading, trim(string_agg(line, chr(10) ORDER BY i), chr(10)) AS body FROM s GROUP BY 1, 2)
SELECT doc_id, heading, body FROM g WHERE trim(body, e' \n\t\r') <> ''""")
def markdown_sections(spark, folder):
    parts = F.transform(F.split("text", "\n"), lambda x: F.when(F.length(x) > 200, F.concat(F.lit("## "), x)).otherwise(x))
    md = F.concat(F.array_join(parts, "\n"), F.lit("\n```\n# not a heading\n```"))
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return docs.select("doc_id", F.explode(bind(md, readers.markdown_sections)).alias("s")).select("doc_id", "s.heading", "s.body")


@query("capped_sheets", "S14", """
WITH r AS (SELECT l_suppkey AS material_id, l_returnflag AS sheet, l_orderkey AS row, l_partkey FROM lineitem)
SELECT material_id, sheet, row, sheet || ',' || l_partkey || ',end' AS cells, false AS truncated_rows, false AS truncated_columns FROM r""")
def capped_sheets(spark, folder):
    rows = table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("material_id"), F.col("l_returnflag").alias("sheet"), F.col("l_orderkey").alias("row"),
        F.array("l_returnflag", F.col("l_partkey").cast("string"), F.lit("end")).alias("cells"))
    return readers.capped_sheet(rows).withColumn("cells", F.array_join("cells", ","))


@query("annotation_types", "S12", """
SELECT event_id, CASE event_type WHEN 'view' THEN 'underline' WHEN 'click' THEN 'note' ELSE event_type END AS type FROM events WHERE event_type <> 'error'""")
def annotation_types(spark, folder):
    kind = F.col("event_type")
    viewer = F.when(kind == "view", "Squiggly").when(kind == "click", "Text").when(kind == "error", "Popup").otherwise(kind)
    mapped = table(spark, folder, "events").select("event_id", readers.map_type(viewer).alias("type"))
    return mapped.where("type IS NOT NULL")


PHRASES = "phrases AS (SELECT [" + ", ".join(f"'{p}'" for p in SCAN_ARTIFACT_PHRASES) + "] AS list)"
BOXES = PHRASES + """,
boxes AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_discount * 200 AS x0, l_tax * 200 AS y0, l_discount * 200 + l_quantity * 12 AS x1,
         l_tax * 200 + l_extendedprice / 90 AS y1, l_returnflag, l_linestatus FROM lineitem),
sized AS (SELECT *, greatest(x1 - x0, 0) AS w, greatest(y1 - y0, 0) AS h FROM boxes),
tested AS (
  SELECT *, w > 0 AND h > 0 AND (w < 48 OR h < 48 OR w * h < 3500) AS tiny,
         x0 <= 1 AND y0 <= 1 AND w >= 400 AND h >= 700 AS full_page,
         CASE l_linestatus WHEN 'O' THEN 'embedded' ELSE 'rasterized' END AS method,
         CASE l_returnflag WHEN 'A' THEN 'A ' || upper(phrases.list[1 + l_partkey % len(phrases.list)]) || '.' WHEN 'N' THEN 'drawing ' || left(phrases.list[1 + l_partkey % len(phrases.list)], 5) ELSE 'drawing' END AS description,
         CASE WHEN l_returnflag = 'R' AND l_linenumber = 1 THEN ' Decorative ' ELSE 'substantive' END AS relevance FROM sized, phrases)"""


def _boxes(spark, folder):
    x0, y0 = F.col("l_discount") * 200, F.col("l_tax") * 200
    phrase = F.get(F.array(*map(F.lit, SCAN_ARTIFACT_PHRASES)), (F.col("l_partkey") % len(SCAN_ARTIFACT_PHRASES)).cast("int"))
    box = F.array(x0, y0, x0 + F.col("l_quantity") * 12, y0 + F.col("l_extendedprice") / 90)
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", box.alias("box"),
        F.when(F.col("l_linestatus") == "O", "embedded").otherwise("rasterized").alias("method"),
        F.when(F.col("l_returnflag") == "A", F.concat(F.lit("A "), F.upper(phrase), F.lit(".")))
        .when(F.col("l_returnflag") == "N", F.concat(F.lit("drawing "), F.substring(phrase, 1, 5))).otherwise("drawing").alias("description"),
        F.when((F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 1), " Decorative ").otherwise("substantive").alias("relevance"))


IDS = "l_orderkey, l_linenumber, l_partkey"


@query("bbox_geometry", "X34", with_ctes(BOXES) + f"SELECT {IDS}, round(w * h, 4) AS area, tiny, full_page FROM tested")
def bbox_geometry(spark, folder):
    box = F.col("box")
    return _boxes(spark, folder).select(
        "l_orderkey", "l_linenumber", "l_partkey", F.round(G.area(box), 4).alias("area"), G.is_tiny(box).alias("tiny"), G.is_full_page(box).alias("full_page"))


@query("deletable_figures", "F14 H15", with_ctes(BOXES) + f"""
SELECT {IDS} FROM tested WHERE lower(trim(relevance)) IN ('decorative', 'front_matter')
  OR (method = 'embedded' AND (tiny OR full_page) AND EXISTS (SELECT 1 FROM (SELECT unnest(list) AS p FROM phrases) WHERE contains(lower(description), p)))""")
def deletable_figures(spark, folder):
    drop = G.deletable(F.col("relevance"), F.col("method"), F.col("box"), F.col("description"))
    return _boxes(spark, folder).where(drop).select("l_orderkey", "l_linenumber", "l_partkey")


@query("page_scan_test", "F15", with_ctes(BOXES) + f"""
SELECT {IDS}, CASE WHEN w * h / 360000 >= 0.9 THEN true WHEN w * h / 360000 < 0.8 OR h = 0 THEN false ELSE abs(w / h - 1.0) <= 0.15 END AS is_scan FROM tested""")
def page_scan_test(spark, folder):
    scan = G.is_page_scan(F.lit(600.0), F.lit(600.0), F.lit("x" * 500), F.col("box"))
    return _boxes(spark, folder).select("l_orderkey", "l_linenumber", "l_partkey", scan.alias("is_scan"))


@query("figure_hints", "X36", with_ctes(BOXES) + f"""
SELECT {IDS}, CASE WHEN full_page THEN 'near-full-page capture; likely scan artifact or text page rather than a standalone figure'
  WHEN tiny THEN 'very small crop; likely inline artifact, partial scan fragment, icon, or empty non-figure' ELSE '' END AS hint FROM tested""")
def figure_hints(spark, folder):
    return _boxes(spark, folder).select("l_orderkey", "l_linenumber", "l_partkey", G.hint(F.col("method"), F.col("box"), F.col("description")).alias("hint"))


@query("merged_regions", "X35 H24 S17", None)
def merged_regions(spark, folder):
    box = F.col("box")
    rects = _boxes(spark, folder).select("l_orderkey", *[F.get(box, F.lit(i)).alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))])
    return G.merged_regions(rects, ["l_orderkey"])


def _postings(spark, folder):
    return postings.build(table(spark, folder, "documents").select("doc_id", "text"), "doc_id", "text")


@query("postings_build", "W1", r"""
WITH t AS (SELECT doc_id, regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+') AS t FROM documents),
u AS (SELECT doc_id, len(t) AS length, unnest(t) AS term FROM t)
SELECT term, doc_id, count(*) AS tf, max(length) AS length FROM u GROUP BY 1, 2""")
def postings_build(spark, folder):
    return _postings(spark, folder).select("term", "doc_id", "tf", "length")


@query("postings_term_stats", "K1", r"""
WITH u AS (SELECT doc_id, unnest(regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+')) AS term FROM documents)
SELECT term, count(DISTINCT doc_id) AS documents, count(*) AS uses FROM u GROUP BY 1""")
def postings_term_stats(spark, folder):
    return postings.term_stats(_postings(spark, folder))


@query("search_via_postings", "W1 J1 F5", with_ctes(bm25_cte("hits", "documents", "doc_id", ["text"], "reer inhe mente")) + """
SELECT doc_id, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM hits ORDER BY score DESC, doc_id LIMIT 20""")
def search_via_postings(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    hits = postings.bm25(_postings(spark, folder), postings.lengths(docs, "doc_id", "text"), "doc_id", ["reer", "inhe", "mente"])
    top = best(hits, 20, F.desc("score"), F.asc("doc_id"))
    return top.select("doc_id", rounded(F.col("score")).alias("score"), "rank")
