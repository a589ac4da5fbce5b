"""Tables and manifests that are written to the shared folder and read back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from lectern.functions.lists import canonical_hash, content_hash
from lectern.functions.text import lines
from lectern.operators.quality import missing_fields
from lectern.plans import corpus
from lectern.plans.corpus import CHUNKS, FIGURES, MATERIALS, table, with_ctes
from lectern.plans.incremental import MANIFEST, manifest_of, snapshot_of
from lectern.plans.registry import query
from lectern.sources import paths, readers, writers


def _shared(spark, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share; our own where that is unset, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        base = tempfile.mkdtemp(prefix="lectern-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("index_published", "K1", with_ctes(MATERIALS) + """
SELECT material_id, domain, collection, title, length(text) AS chars FROM materials WHERE domain <> 'es'""")
def index_published(spark, folder):
    """A rebuilt card table: an older version is published, then the new one; readers get the new one whole."""
    path = _shared(spark, "cards")
    cards = corpus.materials(spark, folder).select(
        "material_id", "domain", "collection", "title", F.length("text").cast("bigint").alias("chars"))
    writers.publish(cards, path)
    writers.publish(cards.where("domain != 'es'"), path)
    return writers.published(spark, path)


@query("manifest_round_trip", "K5 S4", """
SELECT CAST(doc_id AS VARCHAR) AS material_id, sha256(text) AS file_hash, source || CASE WHEN lang = 'de' THEN '/moved/' ELSE '/' END || doc_id AS relative_path
FROM documents""")
def manifest_round_trip(spark, folder):
    """Manifest lines written twice for the materials that moved; the later line rules."""
    path = _shared(spark, "manifest")
    rows = table(spark, folder, "documents").select(
        F.col("doc_id").cast("string").alias("material_id"), content_hash(F.col("text")).alias("file_hash"), "lang", "source")
    first = rows.withColumn("relative_path", F.concat_ws("/", "source", "material_id"))
    second = rows.where("lang = 'de'").withColumn("relative_path", F.concat_ws("/", "source", F.lit("moved"), "material_id"))
    writers.write_manifest(first.drop("lang", "source"), f"{path}/1")
    writers.write_manifest(second.drop("lang", "source"), f"{path}/2")
    return readers.read_manifest(spark, f"{path}/*").select("material_id", "file_hash", "relative_path")


@query("ignored_appended", "K10", """
SELECT DISTINCT sha256(text) AS file_hash FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 OR quality = 0""")
def ignored_appended(spark, folder):
    """The ignore list with new entries, one per file hash."""
    docs = table(spark, folder, "documents").select("doc_id", content_hash(F.col("text")).alias("file_hash"))
    labels = table(spark, folder, "labels")
    old = docs.join(labels.where("toxic = 1"), "doc_id").select("file_hash", F.lit("old").alias("why"))
    added = docs.join(labels.where("quality = 0"), "doc_id").select("file_hash")
    return writers.append_ignored(old, added).select("file_hash")


REQUIRED = ("material_id", "file_hash", "source_path", "title", "domain", "collection", "page_count", "file_type")


@query("missing_metadata", "F13 G15", """
WITH m AS (
  SELECT d.doc_id, CAST(d.doc_id AS VARCHAR) AS material_id, CASE WHEN n_chars > 60 THEN sha256(text) ELSE '' END AS file_hash,
    CASE WHEN doc_id % 50 = 7 THEN NULL ELSE source || '/' || doc_id END AS source_path, trim(string_split(text, chr(10))[1]) AS title,
    CASE lang WHEN 'es' THEN 'Proyectos' WHEN 'fr' THEN 'practice' ELSE 'research' END AS domain, source AS collection,
    CASE WHEN len(string_split(text, chr(10))) > 1 THEN len(string_split(text, chr(10))) END AS page_count,
    CASE WHEN doc_id % 40 = 3 THEN '' ELSE 'pdf' END AS file_type, CAST(quality AS VARCHAR) AS raw_document_type
  FROM documents d LEFT JOIN labels USING (doc_id)),
f AS (SELECT doc_id, array_to_string(list_filter([
  CASE WHEN coalesce(material_id, '') = '' THEN 'material_id' END, CASE WHEN coalesce(file_hash, '') = '' THEN 'file_hash' END,
  CASE WHEN coalesce(source_path, '') = '' THEN 'source_path' END, CASE WHEN coalesce(title, '') = '' THEN 'title' END,
  CASE WHEN coalesce(domain, '') = '' THEN 'domain' END, CASE WHEN coalesce(collection, '') = '' THEN 'collection' END,
  CASE WHEN page_count IS NULL THEN 'page_count' END, CASE WHEN coalesce(file_type, '') = '' THEN 'file_type' END,
  CASE WHEN lower(domain) <> 'proyectos' AND coalesce(raw_document_type, '') = '' THEN 'raw_document_type' END], lambda x: x IS NOT NULL), ', ') AS fields FROM m)
SELECT doc_id, fields FROM f WHERE fields <> ''""")
def missing_metadata(spark, folder):
    """Required fields that a material lacks; the document type is not asked of project materials."""
    labels = table(spark, folder, "labels").select("doc_id", F.col("quality").cast("string").alias("raw_document_type"))
    pieces = F.size(lines(F.col("text")))
    m = table(spark, folder, "documents").join(labels, "doc_id", "left").select(
        "doc_id", F.col("doc_id").cast("string").alias("material_id"),
        F.when(F.col("n_chars") > 60, content_hash(F.col("text"))).otherwise("").alias("file_hash"),
        F.when(F.col("doc_id") % 50 != 7, F.concat_ws("/", "source", "doc_id")).alias("source_path"),
        corpus.first_line(F.col("text")).alias("title"),
        F.when(F.col("lang") == "es", "Proyectos").when(F.col("lang") == "fr", "practice").otherwise("research").alias("domain"),
        F.col("source").alias("collection"), F.when(pieces > 1, pieces).alias("page_count"),
        F.when(F.col("doc_id") % 40 == 3, "").otherwise("pdf").alias("file_type"), "raw_document_type")
    asked = {name: F.col(name) for name in REQUIRED}
    asked["raw_document_type"] = F.when(F.lower("domain") == "proyectos", "-").otherwise(F.col("raw_document_type"))
    return m.select("doc_id", missing_fields(asked).alias("fields")).where("fields != ''")


WANTED = "wanted AS (SELECT page_id AS material_id, 'fig_000' || (1 + page_id % 5) AS figure_id FROM pages)"


@query("figures_by_id", "F9", with_ctes(FIGURES, WANTED) + """
SELECT w.material_id, w.figure_id, f.description, CASE WHEN f.figure_id IS NULL THEN 'figure not found' ELSE '' END AS error
FROM wanted w LEFT JOIN figures f ON f.material_id = w.material_id AND f.figure_id = w.figure_id""")
def figures_by_id(spark, folder):
    """One figure of every page, looked up by its number; an absent one is answered with an error."""
    wanted = table(spark, folder, "pages").select(
        F.col("page_id").alias("material_id"), F.format_string("fig_%04d", 1 + F.col("page_id") % 5).alias("figure_id"))
    known = corpus.figures(spark, folder).select("material_id", "figure_id", "description", F.lit(True).alias("known"))
    return wanted.join(known, ["material_id", "figure_id"], "left").select(
        "material_id", "figure_id", "description", F.when(F.col("known").isNull(), "figure not found").otherwise("").alias("error"))


@query("pages_by_number", "F9", """
WITH p AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)
SELECT doc_id, 1 + doc_id % 4 AS page_number, CASE WHEN 1 + doc_id % 4 <= len(l) THEN l[1 + doc_id % 4] END AS text,
  CASE WHEN 1 + doc_id % 4 <= len(l) THEN '' ELSE 'page not found' END AS error FROM p""")
def pages_by_number(spark, folder):
    """One page of each material by its number; past the last one there is an error."""
    asked = 1 + F.col("doc_id") % 4
    found = F.get(lines(F.col("text")), (asked - 1).cast("int"))
    return table(spark, folder, "documents").select(
        "doc_id", asked.alias("page_number"), found.alias("text"),
        F.when(found.isNull(), "page not found").otherwise("").alias("error"))


@query("pruned_materials", "K9", with_ctes(MANIFEST) + """,
live AS (SELECT CASE WHEN file_hash < '2' THEN 'research/Previos/' || path ELSE path END AS path, path AS was, file_hash FROM snap)
SELECT material_id, path, CASE WHEN path NOT IN (SELECT was FROM live) THEN 'source is gone' ELSE 'in an ignored folder' END AS why
FROM manifest WHERE path NOT IN (SELECT path FROM live)""")
def pruned_materials(spark, folder):
    """Materials whose source vanished or was moved into an ignored folder."""
    live = snapshot_of(spark, folder).select(F.col("path").alias("at"), F.when(
        F.col("file_hash") < "2", F.concat(F.lit("research/Previos/"), F.col("path"))).otherwise(F.col("path")).alias("live_path"))
    known = manifest_of(spark, folder).join(live, F.col("path") == F.col("at"), "left")
    ignored = F.coalesce(paths.in_ignored_folder(F.col("live_path")), F.lit(False))
    return known.where(F.col("at").isNull() | ignored).select(
        "material_id", "path", F.when(F.col("at").isNull(), "source is gone").otherwise("in an ignored folder").alias("why"))


@query("sampled_figures", "O3", with_ctes(FIGURES) + """
SELECT material_id, figure_id, image_path FROM figures WHERE image_path <> '' ORDER BY md5('7:' || material_id || ':' || figure_id) LIMIT 20""")
def sampled_figures(spark, folder):
    """A random sample of figures with an image that the same seed repeats anywhere."""
    rows = corpus.figures(spark, folder).where("image_path != ''").select("material_id", "figure_id", "image_path")
    return rows.orderBy(F.md5(F.concat_ws(":", F.lit("7"), "material_id", "figure_id"))).limit(20)


@query("stage_fingerprints", "G18 A25", with_ctes(CHUNKS, FIGURES) + """,
parts AS (
  SELECT material_id, 'chunk' AS stage, chunk_id AS part, substr(sha256(CAST(to_json({'p0': chunk_id, 'p1': text, 'p2': CAST(emphasized AS VARCHAR)}) AS VARCHAR)), 1, 16) AS fp FROM chunks
  UNION ALL
  SELECT material_id, 'figure', figure_id, substr(sha256(CAST(to_json({'p0': figure_id, 'p1': CAST(source_page AS VARCHAR), 'p2': sha256(description)}) AS VARCHAR)), 1, 16) FROM figures
  UNION ALL
  SELECT doc_id, 'metadata', 'first pages', substr(sha256(CAST(to_json({'p0': lang, 'p1': source, 'p2': sha256(array_to_string(string_split(text, chr(10))[1:4], chr(10)))}) AS VARCHAR)), 1, 16) FROM documents)
SELECT material_id, stage, part, fp FROM parts""")
def stage_fingerprints(spark, folder):
    """Fingerprints of single chunks, of figures, and of the first four pages for the metadata pass."""
    chunks = corpus.chunks(spark, folder).select("material_id", F.lit("chunk").alias("stage"), F.col("chunk_id").alias("part"), canonical_hash(
        F.col("chunk_id"), F.col("text"), F.col("emphasized")).alias("fp"))
    figures = corpus.figures(spark, folder).select("material_id", F.lit("figure").alias("stage"), F.col("figure_id").alias("part"), canonical_hash(
        F.col("figure_id"), F.col("source_page"), content_hash(F.col("description"))).alias("fp"))
    first = F.array_join(F.slice(lines(F.col("text")), 1, 4), "\n")
    meta = table(spark, folder, "documents").select(
        F.col("doc_id").alias("material_id"), F.lit("metadata").alias("stage"), F.lit("first pages").alias("part"),
        canonical_hash(F.col("lang"), F.col("source"), content_hash(first)).alias("fp"))
    return chunks.unionByName(figures).unionByName(meta)
