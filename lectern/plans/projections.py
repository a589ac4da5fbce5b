"""Flattening, JSON handling and text assembly."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import citations as C
from lectern.functions import lists as L
from lectern.functions import names as N
from lectern.functions import responses as R
from lectern.functions.fixed import RELEVANCE_CONFIDENCE
from lectern.functions.text import bind
from lectern.plans import corpus
from lectern.plans.corpus import ANNOTATIONS, CHUNKS, CONCEPTS, FIGURES, table, with_ctes
from lectern.plans.registry import query


@query("enriched_flatten", "P1 P2 P10", """
SELECT p_partkey, CASE WHEN p_size > 40 THEN '' WHEN p_size > 20 THEN p_name ELSE p_name || ' ' || p_brand END AS value,
  CASE WHEN p_size > 40 THEN '[]' WHEN p_size > 20 THEN '["' || p_name || '"]' ELSE '["' || p_name || '","' || p_brand || '"]' END AS keywords FROM part""")
def enriched_flatten(spark, folder):
    listed = F.to_json(F.struct(F.array("p_name", "p_brand").alias("value")))
    single = F.to_json(F.struct(F.col("p_name").alias("value")))
    field = F.try_parse_json(F.when(F.col("p_size") > 40, "{}").when(F.col("p_size") > 20, single).otherwise(listed))
    return table(spark, folder, "part").select("p_partkey", L.flatten_value(field).alias("value"), L.keyword_json(field).alias("keywords"))


@query("material_wide_rows", "P3", """
SELECT d.doc_id AS material_id, lang AS domain, source AS collection, trim(string_split(text, chr(10))[1]) AS title,
  coalesce(CAST(l.quality AS VARCHAR), '') AS scale, coalesce(CAST(l.toxic AS VARCHAR), '') AS climate, n_chars AS page_count
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def material_wide_rows(spark, folder):
    labels = table(spark, folder, "labels").select(F.col("doc_id").alias("material_id"), "quality", "toxic")
    size = table(spark, folder, "documents").select(F.col("doc_id").alias("material_id"), F.col("n_chars").alias("page_count"))
    rows = corpus.materials(spark, folder).select("material_id", "domain", "collection", "title").join(size, "material_id").join(labels, "material_id", "left")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return rows.select("material_id", "domain", "collection", "title", text("quality").alias("scale"), text("toxic").alias("climate"), "page_count")


@query("material_card_counts", "P8", with_ctes(CHUNKS, ANNOTATIONS, FIGURES, CONCEPTS) + """
SELECT d.doc_id AS material_id, coalesce(c.n, 0) AS chunks, coalesce(a.n, 0) AS annotations, coalesce(f.n, 0) AS figures, coalesce(k.n, 0) AS concepts
FROM documents d LEFT JOIN (SELECT material_id, count(*) AS n FROM chunks GROUP BY 1) c ON c.material_id = d.doc_id
LEFT JOIN (SELECT material_id, count(*) AS n FROM annotations GROUP BY 1) a ON a.material_id = d.doc_id
LEFT JOIN (SELECT material_id, count(*) AS n FROM figures GROUP BY 1) f ON f.material_id = d.doc_id
LEFT JOIN (SELECT material_id, count(*) AS n FROM concepts GROUP BY 1) k ON k.material_id = d.doc_id""")
def material_card_counts(spark, folder):
    """One shuffle for all child tables: counts are summed from a union."""
    kinds = ("chunks", "annotations", "figures", "concepts")
    builders = (corpus.chunks, corpus.annotations, corpus.figures, corpus.concepts)
    base = table(spark, folder, "documents").select(F.col("doc_id").alias("material_id"), F.lit("card").alias("kind"))
    rows = base
    for kind, build in zip(kinds, builders):
        rows = rows.unionByName(build(spark, folder).select("material_id", F.lit(kind).alias("kind")))
    counts = [F.count_if(F.col("kind") == k).alias(k) for k in kinds]
    return rows.groupBy("material_id").agg(F.count_if(F.col("kind") == "card").alias("_card"), *counts).where("_card > 0").drop("_card")


@query("wiki_paths", "P11 H18", """
SELECT doc_id, 'wiki/' || lang || '/' || CASE WHEN source = 'src1' THEN '_general' ELSE source END || '/' || doc_id || '.md' AS material_path,
  'wiki/' || lang || '/' || CASE WHEN source = 'src1' THEN '_general' ELSE source END || '/concepts/' || source || '.md' AS concept_path,
  'wiki/shared/bridge-concepts/' || source || '.md' AS bridge_path FROM documents""")
def wiki_paths(spark, folder):
    scope = F.when(F.col("source") == "src1", "  ").otherwise(F.col("source"))
    return table(spark, folder, "documents").select(
        "doc_id", N.material_path(F.col("lang"), scope, F.col("doc_id")).alias("material_path"),
        N.concept_path(F.col("lang"), scope, F.col("source")).alias("concept_path"), N.bridge_path(F.lit(""), F.col("source")).alias("bridge_path"))


@query("collection_titles", "P12 X45", """
SELECT DISTINCT upper(left(lang, 1)) || substr(lang, 2) || ' / Src ' || substr(source, 4) AS title FROM documents""")
def collection_titles(spark, folder):
    name = F.concat(F.lit("src_"), F.substring("source", 4, 10))
    return table(spark, folder, "documents").select(N.collection_title(F.col("lang"), name).alias("title")).distinct()


@query("citations", "P14", """
SELECT p_partkey, CASE WHEN p_type = 'SMALL' THEN 'Writer, Ann B., and Co Editor. "' || p_name || '." _Journal of ' || p_brand || '_ ' || p_size || ', no. 2 (1999): 3–9. https://doi.org/10.1/x'
  WHEN p_type = 'ECONOMY' THEN 'Writer, Ann B., and Co Editor. "' || p_name || '." In _Book_, edited by Ed One, 3–9. Oslo: Press, 1999.'
  WHEN p_type = 'MEDIUM' THEN 'Writer, Ann B., and Co Editor. _' || p_name || '_. 2nd ed. Oslo: Press, 1999.'
  ELSE 'Writer, Ann B., and Co Editor. _' || p_name || '_. 1999.' END AS citation FROM part""")
def citations(spark, folder):
    kind, none = F.col("p_type"), F.lit("")
    only = lambda wanted, value: F.when(kind.isin(*wanted), value).otherwise("")
    printed = ("ECONOMY", "MEDIUM")
    fields = {
        "authors": F.array(F.lit("Ann B. Writer"), F.lit(" Co Editor ")), "title": F.col("p_name"), "year": F.lit("1999"), "document_type": none,
        "journal": only(("SMALL",), F.concat(F.lit("Journal of "), "p_brand")), "volume": F.col("p_size").cast("string"), "issue": F.lit("2"),
        "start_page": F.lit("3"), "end_page": F.lit("9"), "doi": F.lit("https://doi.org/10.1/x"),
        "book_title": only(("ECONOMY",), F.lit("Book")), "editors": F.array(F.lit("Ed One")),
        "publisher": only(printed, F.lit("Press")), "place": only(printed, F.lit("Oslo")), "edition": F.lit("2nd"),
    }
    return table(spark, folder, "part").select("p_partkey", C.citation(fields).alias("citation"))


@query("context_headers", "X32", """
SELECT p_partkey, 'Title: ' || p_name || chr(10) || 'Domain: ' || chr(10) || 'Bridge concepts: ' || p_brand || ', ' || p_type || chr(10) || chr(10) ||
  'Table of Contents:' || chr(10) || 'Not available' || chr(10) || chr(10) || 'Section headings:' || chr(10) || '  - ' || p_name AS header FROM part""")
def context_headers(spark, folder):
    bridges = F.array("p_brand", F.lit(""), "p_type")
    return table(spark, folder, "part").select("p_partkey", C.context_header(
        [("Title", F.col("p_name")), ("Domain", F.lit(None).cast("string"))], bridges, F.lit("Not available"), F.array("p_name")).alias("header"))


@query("provenance_stamped", "P17 P16", """
SELECT c_custkey, c_name, '' AS descriptor, '{"route_signature":"r1","run_at":"2024-01-01T00:00:00Z"}' AS provenance FROM customer""")
def provenance_stamped(spark, folder):
    """Older rows without a descriptor get an empty one; then the run is stamped."""
    old = table(spark, folder, "customer").select("c_custkey", "c_name")
    current = old.where("false").withColumn("descriptor", F.lit(""))
    rows = current.unionByName(old, allowMissingColumns=True)
    stamp = F.to_json(F.struct(F.lit("r1").alias("route_signature"), F.lit("2024-01-01T00:00:00Z").alias("run_at")))
    return rows.select("c_custkey", "c_name", F.coalesce("descriptor", F.lit("")).alias("descriptor"), stamp.alias("provenance"))


@query("bridge_backrefs", "P18", """
SELECT DISTINCT l_partkey AS material_id, n_name AS bridge
FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey""")
def bridge_backrefs(spark, folder):
    """Bridges of each material, sorted by material and caseless name.

    A global sort splits a material with very many bridges over tasks, which a
    per-material window could not.
    """
    homes = table(spark, folder, "supplier").join(table(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("cluster_id"), F.col("n_name").alias("bridge"))
    pairs = table(spark, folder, "lineitem").select(F.col("l_suppkey").alias("cluster_id"), F.col("l_partkey").alias("material_id"))
    return pairs.join(homes, "cluster_id").select("material_id", "bridge").distinct().orderBy("material_id", F.lower("bridge"))


@query("json_lists", "X3 P19", """
SELECT p_partkey, CASE WHEN p_size > 45 THEN '' WHEN p_size > 40 THEN '' ELSE p_name || '|' || p_brand END AS items FROM part""")
def json_lists(spark, folder):
    good = F.concat(F.lit('["'), "p_name", F.lit('", " '), "p_brand", F.lit(' ", "  "]'))
    text = F.when(F.col("p_size") > 45, '{"a": 1}').when(F.col("p_size") > 40, "[broken").otherwise(good)
    return table(spark, folder, "part").select("p_partkey", F.array_join(L.json_list(text), "|").alias("items"))


@query("tolerant_json", "X37", """
SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events""")
def tolerant_json(spark, folder):
    kind = F.col("event_type")
    text = (
        F.when(kind == "view", F.col("props"))
        .when(kind == "click", F.concat(F.lit("Here it is:\n```json\n"), "props", F.lit("\n```\nDone.")))
        .otherwise(F.concat("props", F.lit(" and some trailing words"))))
    return table(spark, folder, "events").select("event_id", text.alias("t")).select(
        "event_id", F.try_variant_get(R.parse_or_prefix(F.col("t")), "$.k", "bigint").alias("k"))


@query("json_salvage", "X38 X39", """
SELECT p_partkey, 'chk_' || p_partkey AS chunk_id, p_name AS summary, p_brand || '|two|three' AS keywords,
  CASE WHEN p_type = 'SMALL' THEN 'argument' ELSE '' END AS content_class FROM part
UNION ALL SELECT p_partkey, 'alt_' || p_partkey, 'short text', '', '' FROM part""")
def json_salvage(spark, folder):
    first = F.to_json(F.struct(
        F.concat(F.lit("chk_"), "p_partkey").alias("id"), F.concat("p_name", F.lit("  ")).alias("s"),
        F.array("p_brand", F.lit("two"), F.lit(" three "), F.lit("four")).alias("kw"),
        F.when(F.col("p_type") == "SMALL", "argument").otherwise("poem").alias("cls")))
    second = F.to_json(F.struct(F.concat(F.lit("alt_"), "p_partkey").alias("chunk_id"), F.lit("short\n text").alias("summary")))
    raw = F.concat(F.lit("• "), first, F.lit(" "), second, F.lit(" {broken")).alias("raw")
    rows = table(spark, folder, "part").select("p_partkey", raw)
    objects = rows.select("p_partkey", F.explode(bind(F.col("raw"), L.json_objects)).alias("o"))
    return R.chunk_responses(objects, "o", ["p_partkey"])


@query("descriptors_cleaned", "H36", "SELECT p_partkey, p_name || ' of ' || p_brand AS descriptor FROM part")
def descriptors_cleaned(spark, folder):
    body = F.concat("p_name", F.lit(" of "), "p_brand")
    raw = (
        F.when(F.col("p_type") == "SMALL", F.concat(F.lit("```json\n{\"descriptor\": \""), body, F.lit("\"}\n```")))
        .when(F.col("p_type") == "ECONOMY", F.concat(F.lit(" Summary: \""), body, F.lit("\" ")))
        .otherwise(F.concat("p_name", F.lit("\n of "), "p_brand")))
    return table(spark, folder, "part").select("p_partkey", bind(raw, R.clean_descriptor).alias("descriptor"))


@query("concept_confidence", "H14", with_ctes(CONCEPTS) + """
SELECT material_id, concept_key, CASE relevance WHEN 'high' THEN 1.0::DOUBLE WHEN 'medium' THEN 0.7 ELSE 0.4 END AS confidence FROM concepts""")
def concept_confidence(spark, folder):
    scale = F.lit(0.7)
    for level, value in RELEVANCE_CONFIDENCE.items():
        scale = F.when(F.lower("relevance") == level, value).otherwise(scale)
    return corpus.concepts(spark, folder).select("material_id", "concept_key", scale.alias("confidence"))


@query("glossary_lines", "X48", """
SELECT DISTINCT upper(left(p_name, 1)) AS letter, '- [' || p_name || '](' || replace(p_name, ' ', '-') || '.md)' AS line FROM part ORDER BY 2""")
def glossary_lines(spark, folder):
    """Glossary entries by letter, as rows that the page sink writes in order."""
    line = F.concat(F.lit("- ["), "p_name", F.lit("]("), N.slugify(F.col("p_name")), F.lit(".md)"))
    return table(spark, folder, "part").select(F.upper(F.substring("p_name", 1, 1)).alias("letter"), line.alias("line")).distinct().orderBy("line")


@query("json_results", "K7 X50", """
SELECT '{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '","c_mktsegment":"' || c_mktsegment || '"}' AS json FROM customer""")
def json_results(spark, folder):
    from lectern.sources.writers import as_json

    return as_json(table(spark, folder, "customer").select("c_custkey", "c_name", "c_mktsegment"))


@query("settings_merged", "X42", """
SELECT n_nationkey, 'name=' || n_name || ',region=' || n_regionkey AS settings FROM nation""")
def settings_merged(spark, folder):
    """Override wins per key; keys of either side stay."""
    base = F.create_map(F.lit("name"), F.lit("default"), F.lit("region"), F.col("n_regionkey").cast("string"))
    over = F.create_map(F.lit("name"), F.col("n_name"))
    merged = F.map_zip_with(base, over, lambda k, a, b: F.coalesce(b, a))
    shown = F.array_join(F.transform(F.array_sort(F.map_entries(merged)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return table(spark, folder, "nation").select("n_nationkey", shown.alias("settings"))
