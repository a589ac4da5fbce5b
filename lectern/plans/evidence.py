"""Evidence samples and packets per material."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.operators import search as search_ops
from lectern.operators.evidence import sample_per
from lectern.operators.ranking import query_phrases
from lectern.plans import corpus
from lectern.plans.corpus import ANNOTATIONS, CHUNKS, CONCEPTS, FIGURES, table, with_ctes
from lectern.plans.indexes import search
from lectern.plans.registry import query
from lectern.plans.search import bm25_cte, chunk_table

TERM = "thorat"
SAMPLE = """,
first4 AS (SELECT *, row_number() OVER (PARTITION BY material_id ORDER BY emphasized DESC, pos) AS r FROM chunks QUALIFY r <= 4),
scored AS (SELECT *, CASE WHEN contains(lower(text), 'thorat') THEN 1 ELSE 0 END AS relevance FROM first4),
fallback AS (SELECT *, row_number() OVER (PARTITION BY material_id ORDER BY relevance DESC, chunk_id) AS rn FROM scored QUALIFY rn <= 2)"""


def _fallback(spark, folder):
    rows = corpus.chunks(spark, folder)
    first = sample_per(rows, "material_id", 4, F.desc("emphasized"), F.asc("pos")).drop("rn")
    hit = first.withColumn("relevance", F.when(F.lower("text").contains(TERM), 1).otherwise(0).cast("bigint"))
    return sample_per(hit, "material_id", 2, F.desc("relevance"), F.asc("chunk_id"))


@query("evidence_chunks", "W14", with_ctes(CHUNKS) + SAMPLE + "SELECT material_id, chunk_id, CAST(relevance AS BIGINT) AS relevance, rn FROM fallback")
def evidence_chunks(spark, folder):
    return _fallback(spark, folder).select("material_id", "chunk_id", "relevance", "rn")


@query("evidence_annotations", "W14", with_ctes(ANNOTATIONS) + """
SELECT material_id, annotation_id, rn FROM (SELECT *, row_number() OVER (PARTITION BY material_id ORDER BY CASE WHEN comment = '' THEN 1 ELSE 0 END, page) AS rn FROM annotations) WHERE rn <= 2""")
def evidence_annotations(spark, folder):
    rows = corpus.annotations(spark, folder)
    order = F.when(F.col("comment") == "", 1).otherwise(0)
    return sample_per(rows, "material_id", 2, order.asc(), F.asc("page")).select("material_id", "annotation_id", "rn")


@query("evidence_figures", "W14", with_ctes(FIGURES) + """
SELECT material_id, figure_id, rn FROM (SELECT *, row_number() OVER (PARTITION BY material_id ORDER BY CASE WHEN relevance = 'substantive' THEN 0 ELSE 1 END, figure_key) AS rn FROM figures) WHERE rn <= 2""")
def evidence_figures(spark, folder):
    order = F.when(F.col("relevance") == "substantive", 0).otherwise(1)
    return sample_per(corpus.figures(spark, folder), "material_id", 2, order.asc(), F.asc("figure_key")).select("material_id", "figure_id", "rn")


@query("evidence_concepts", "W14", with_ctes(CONCEPTS) + """
SELECT material_id, concept_key, rn FROM (SELECT *, row_number() OVER (PARTITION BY material_id ORDER BY CASE WHEN relevance = 'high' THEN 0 ELSE 1 END, pos) AS rn FROM concepts) WHERE rn <= 4""")
def evidence_concepts(spark, folder):
    order = F.when(F.col("relevance") == "high", 0).otherwise(1)
    return sample_per(corpus.concepts(spark, folder), "material_id", 4, order.asc(), F.asc("pos")).select("material_id", "concept_key", "rn")


@query("evidence_packet", "W15 W14", with_ctes(
    CHUNKS, bm25_cte("h0", "chunks", "chunk_key", ["text"], "thorat mente", carry=("material_id", "chunk_id", "emphasized")),
    bm25_cte("h1", "chunks", "chunk_key", ["text"], "erblest", carry=("material_id", "chunk_id", "emphasized"))) + SAMPLE + """,
pool AS (
  SELECT material_id, chunk_id, 0 AS src, row_number() OVER (PARTITION BY material_id ORDER BY score + CASE WHEN emphasized THEN 0.2 ELSE 0 END DESC, chunk_key) AS r FROM h0 QUALIFY r <= 3
  UNION ALL
  SELECT material_id, chunk_id, 1, row_number() OVER (PARTITION BY material_id ORDER BY score + CASE WHEN emphasized THEN 0.2 ELSE 0 END DESC, chunk_key) AS r FROM h1 QUALIFY r <= 3
  UNION ALL SELECT material_id, chunk_id, 2, rn FROM fallback),
one AS (SELECT material_id, chunk_id, min({'src': src, 'r': r}) AS o FROM pool GROUP BY 1, 2)
SELECT material_id, chunk_id, CASE WHEN o.src = 2 THEN 'fallback' ELSE 'search' END AS source, rn FROM (
  SELECT *, row_number() OVER (PARTITION BY material_id ORDER BY o) AS rn FROM one) WHERE rn <= 3""")
def evidence_packet(spark, folder):
    """Chunks found by each query in turn, filled up from the plain sample."""
    found = []
    for i, ask in enumerate(("thorat mente", "erblest")):
        top = search_ops.top_chunks(search(spark, "chunks", chunk_table(spark, folder), query_phrases(ask)), "material_id", "chunk_key", 3)
        found.append(top.select("material_id", "chunk_id", F.struct(F.lit(i).alias("src"), F.col("rank").cast("bigint").alias("r")).alias("o")))
    found.append(_fallback(spark, folder).select("material_id", "chunk_id", F.struct(F.lit(len(found)).alias("src"), F.col("rn").cast("bigint").alias("r")).alias("o")))
    one = reduce(DataFrame.unionByName, found).groupBy("material_id", "chunk_id").agg(F.min("o").alias("o"))
    return sample_per(one, "material_id", 3, F.asc("o")).select(
        "material_id", "chunk_id", F.when(F.col("o.src") == len(found) - 1, "fallback").otherwise("search").alias("source"), "rn")


@query("collection_selection", "W16", """
WITH c AS (SELECT l_partkey AS material_id, count(DISTINCT l_suppkey) AS overlap FROM lineitem GROUP BY 1),
s AS (SELECT p_brand AS collection, p_partkey AS material_id, p_name AS title, coalesce(overlap, 0) AS overlap FROM part LEFT JOIN c ON material_id = p_partkey)
SELECT collection, material_id, overlap, rn, material_id NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A') AS is_new FROM (
  SELECT *, row_number() OVER (PARTITION BY collection ORDER BY overlap DESC, lower(title), material_id) AS rn FROM s) WHERE rn <= 8""")
def collection_selection(spark, folder):
    counts = corpus.memberships(spark, folder).groupBy("material_id").agg(F.count(F.lit(1)).alias("overlap"))
    parts = table(spark, folder, "part").select(F.col("p_brand").alias("collection"), F.col("p_partkey").alias("material_id"), F.col("p_name").alias("title"))
    scored = parts.join(counts, "material_id", "left").withColumn("overlap", F.coalesce("overlap", F.lit(0)))
    chosen = sample_per(scored, "collection", 8, F.desc("overlap"), F.lower("title").asc(), F.asc("material_id"))
    known = table(spark, folder, "lineitem").where("l_returnflag = 'A'").select(F.col("l_partkey").alias("material_id"), F.lit(True).alias("old")).distinct()
    return chosen.join(known, "material_id", "left").select("collection", "material_id", "overlap", "rn", F.col("old").isNull().alias("is_new"))


@query("material_packets", "A22 H4", with_ctes(CONCEPTS) + """
SELECT material_id, concept_name, relevance, rn FROM (
  SELECT *, row_number() OVER (PARTITION BY material_id ORDER BY concept_name) AS rn FROM concepts) WHERE rn <= 8""")
def material_packets(spark, folder):
    return sample_per(corpus.concepts(spark, folder), "material_id", 8, F.asc("concept_name")).select("material_id", "concept_name", "relevance", "rn")


@query("packet_evidence_spans", "A22", """
SELECT conv_id AS material_id, span, n FROM (
  SELECT conv_id, text AS span, row_number() OVER (PARTITION BY conv_id ORDER BY min(turn)) AS n FROM conversations WHERE trim(text) <> '' GROUP BY conv_id, text) WHERE n <= 5""")
def packet_evidence_spans(spark, folder):
    """Up to five distinct spans per material in first-seen order."""
    spans = table(spark, folder, "conversations").where(F.trim("text") != "").groupBy(
        F.col("conv_id").alias("material_id"), F.col("text").alias("span")).agg(F.min("turn").alias("turn"))
    window = Window.partitionBy("material_id").orderBy("turn")
    return spans.withColumn("n", F.row_number().over(window).cast("bigint")).where("n <= 5").select("material_id", "span", "n")
