"""Glossary, counters, keyword statistics and weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions.fixed import RELEVANCE_BONUS
from lectern.functions.lists import content_hash, set_digest
from lectern.functions.text import estimated_tokens, lines, strip, tidy_line, years
from lectern.operators import evidence, keywords
from lectern.plans import corpus
from lectern.plans.corpus import CATALOGUE, CLUSTERS, CONCEPTS, table, with_ctes
from lectern.plans.registry import query

GLOSSARY = """,
glossary AS (
  SELECT concept_key, max(concept_name) AS display_name, count(DISTINCT material_id) AS material_count
  FROM concepts GROUP BY 1 HAVING count(DISTINCT material_id) >= 2),
listed AS (SELECT * FROM glossary ORDER BY material_count DESC, concept_key LIMIT 100)"""


def _glossary(spark, folder):
    rows = corpus.concepts(spark, folder)
    grouped = rows.groupBy("concept_key").agg(
        F.max("concept_name").alias("display_name"), F.count(F.lit(1)).alias("material_count"))
    return grouped.where("material_count >= 2").orderBy(F.desc("material_count"), "concept_key").limit(100)


@query("concept_glossary_having", "A1", with_ctes(CONCEPTS) + GLOSSARY + "SELECT * FROM listed")
def concept_glossary_having(spark, folder):
    return _glossary(spark, folder)


@query("concept_glossary_members", "A1", with_ctes(CONCEPTS) + GLOSSARY + """
SELECT concept_key, material_id FROM concepts SEMI JOIN listed USING (concept_key)""")
def concept_glossary_members(spark, folder):
    """Member ids of the listed concepts as rows, so no list grows with the corpus."""
    return corpus.concepts(spark, folder).join(_glossary(spark, folder), "concept_key", "left_semi").select("concept_key", "material_id")


@query("relevance_histogram", "A2", with_ctes(CONCEPTS) + """,
n AS (SELECT concept_key, relevance, count(*) AS n FROM concepts GROUP BY 1, 2)
SELECT concept_key, string_agg(CASE WHEN n > 1 THEN n || '×' || relevance ELSE relevance END, ', ' ORDER BY n DESC, relevance) AS summary
FROM n GROUP BY 1""")
def relevance_histogram(spark, folder):
    n = corpus.concepts(spark, folder).groupBy("concept_key", "relevance").agg(F.count(F.lit(1)).alias("n"))
    # At most three relevance levels exist, so the list per key stays tiny.
    per = n.groupBy("concept_key").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), "relevance"))).alias("parts"))
    shown = F.transform("parts", lambda p: F.when(p["m"] < -1, F.concat((-p["m"]).cast("string"), F.lit("×"), p["relevance"])).otherwise(p["relevance"]))
    return per.select("concept_key", F.array_join(shown, ", ").alias("summary"))


@query("collection_counts", "A3 A23", "SELECT lang AS domain, source AS collection, count(*) AS material_count FROM documents GROUP BY 1, 2")
def collection_counts(spark, folder):
    return table(spark, folder, "documents").groupBy(F.col("lang").alias("domain"), F.col("source").alias("collection")).agg(F.count(F.lit(1)).alias("material_count"))


@query("corpus_overview", "A4", with_ctes(corpus.CHUNKS, corpus.FIGURES, CONCEPTS) + """
SELECT (SELECT count(*) FROM documents) AS materials, (SELECT count(*) FROM chunks) AS chunks,
       (SELECT count(*) FROM conversations) AS annotations, (SELECT count(*) FROM figures) AS figures,
       (SELECT count(*) FROM concepts) AS concepts""")
def corpus_overview(spark, folder):
    n = F.count(F.lit(1))
    return table(spark, folder, "documents").agg(n.alias("materials")).select(
        "materials",
        corpus.chunks(spark, folder).agg(n).scalar().alias("chunks"),
        table(spark, folder, "conversations").agg(n).scalar().alias("annotations"),
        corpus.figures(spark, folder).agg(n).scalar().alias("figures"),
        corpus.concepts(spark, folder).agg(n).scalar().alias("concepts"))


@query("collection_search_like", "A5 G25", """
SELECT lang AS domain, source AS collection, count(*) AS material_count, max(trim(string_split(text, chr(10))[1])) AS sample_title
FROM documents WHERE lower(text) LIKE '%thorat%' OR lower(source) LIKE '%thorat%'
GROUP BY 1, 2 ORDER BY material_count DESC, domain, collection LIMIT 20""")
def collection_search_like(spark, folder):
    rows = corpus.materials(spark, folder)
    hit = rows.where(F.lower("text").like("%thorat%") | F.lower("collection").like("%thorat%"))
    return hit.groupBy("domain", "collection").agg(
        F.count(F.lit(1)).alias("material_count"), F.max("title").alias("sample_title")
    ).orderBy(F.desc("material_count"), "domain", "collection").limit(20)


@query("facet_frequency", "A14 H41", with_ctes(CATALOGUE) + """,
f AS (SELECT author AS collection, 'building_type' AS field, building_type AS value FROM catalogue
      UNION ALL SELECT author, 'scale', scale FROM catalogue)
SELECT collection, field, trim(value) AS value, count(*) AS n FROM f WHERE trim(value) <> '' GROUP BY 1, 2, 3 HAVING count(*) >= 2""")
def facet_frequency(spark, folder):
    cat = corpus.catalogue(spark, folder).select(F.col("author").alias("collection"), "building_type", "scale")
    long = cat.unpivot("collection", ["building_type", "scale"], "field", "value").withColumn("value", strip(F.col("value")))
    return long.where("value != ''").groupBy("collection", "field", "value").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")


@query("year_mode", "A18 X20", r"""
WITH c AS (SELECT o_custkey AS material_id, 'Published: ' || year(o_orderdate) || '. Received: 3 May ' || (year(o_orderdate) - 1) AS text FROM orders),
y AS (
  SELECT material_id, unnest(regexp_extract_all(text, '[Pp]ubli(?:shed|cation[\s_-]*date)\s*:?\s*[^0-9]*([0-9]{4})', 1)) AS y FROM c
  UNION ALL
  SELECT material_id, unnest(regexp_extract_all(text, '(?:Received|Accepted|Revised)\s*:?\s*[0-9]{1,2}\s+[\p{L}\p{N}_]+\s+([0-9]{4})', 1)) FROM c
  UNION ALL
  SELECT material_id, unnest(regexp_extract_all(text, '(?:May)\.?\s+([0-9]{4})', 1)) FROM c),
n AS (SELECT material_id, CAST(y AS INTEGER) AS y, count(*) AS n FROM y WHERE CAST(y AS INTEGER) BETWEEN 1800 AND 2100 GROUP BY 1, 2)
SELECT material_id, y AS year FROM n QUALIFY row_number() OVER (PARTITION BY material_id ORDER BY n DESC, y) = 1""")
def year_mode(spark, folder):
    year = F.year("o_orderdate")
    text = F.concat(F.lit("Published: "), year.cast("string"), F.lit(". Received: 3 May "), (year - 1).cast("string"))
    found = table(spark, folder, "orders").select(F.col("o_custkey").alias("material_id"), F.explode(years(text)).alias("year"))
    counts = found.groupBy("material_id", "year").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("material_id").agg(F.max_by("year", F.struct("n", -F.col("year"))).alias("year"))


def _stop_list() -> str:
    from lectern.functions.fixed import STOP_WORDS
    return ", ".join(f"'{w}'" for w in STOP_WORDS)


TERMS = f"""
page_rows AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS p FROM documents),
page_tokens AS (
  SELECT doc_id, p, list_filter(regexp_extract_all(lower(replace(line, chr(173), '')), '[a-zA-ZÀ-ÿ]{{3,}}'), lambda w: w NOT IN ({_stop_list()})) AS t
  FROM page_rows),
totals AS (SELECT doc_id, CAST(sum(len(t)) AS BIGINT) AS total, count(*) AS page_count FROM page_tokens GROUP BY 1),
uni AS (SELECT doc_id, p, unnest(t) AS term FROM page_tokens),
bi AS (SELECT doc_id, p, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS term FROM page_tokens),
counts AS (
  SELECT doc_id, term, false AS pair, count(*) AS tf, count(DISTINCT p) AS pages_with FROM uni GROUP BY 1, 2
  UNION ALL SELECT doc_id, term, true, count(*), 0 FROM bi GROUP BY 1, 2)"""


def _counts(spark, folder, pairs_only=False):
    docs = table(spark, folder, "documents").select("doc_id", "text").select("doc_id", lines(F.col("text")).alias("pages"))
    return keywords.term_counts(docs, "doc_id", "pages", pairs_only)


@query("term_tf_df", "A16 X14", with_ctes(TERMS) + """
SELECT doc_id, term, tf, pages_with, total, page_count FROM counts JOIN totals USING (doc_id) WHERE NOT pair""")
def term_tf_df(spark, folder):
    return _counts(spark, folder).where("NOT pair").select("doc_id", "term", "tf", "pages_with", "total", "page_count")


@query("bigram_counts", "A15", with_ctes(TERMS) + "SELECT doc_id, term, tf FROM counts WHERE pair AND tf >= 2")
def bigram_counts(spark, folder):
    return _counts(spark, folder, pairs_only=True).where("tf >= 2").select("doc_id", "term", "tf")


@query("tfidf_keywords", "X15 O11", with_ctes(TERMS) + """,
scored AS (
  SELECT doc_id, term, round(CASE WHEN pair THEN tf / total * 2.0 ELSE tf / total * (ln((page_count + 1) / (pages_with + 1)) + 1) END, 9) AS score
  FROM counts JOIN totals USING (doc_id) WHERE NOT pair OR tf >= 2)
SELECT doc_id, term, score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, term) AS rank FROM scored) WHERE rank <= 15""")
def tfidf_keywords(spark, folder):
    top = keywords.top_keywords(keywords.scored(_counts(spark, folder)), "doc_id")
    return top.select("doc_id", "term", "score", "rank")


@query("header_footer_lines", "A17", r"""
WITH p AS (
  SELECT source, list_filter(list_transform(string_split(text, chr(10)), lambda x:
    trim(regexp_replace(regexp_replace(x, '[ \t]+', ' ', 'g'), '[\s\p{Z}]+([,.;:!?])', '\1', 'g'))), lambda x: x <> '') AS l FROM documents),
e AS (SELECT source, list_distinct(list_concat(l[1:3], l[greatest(len(l) - 2, 1):])) AS s FROM p),
u AS (SELECT source, unnest(s) AS line FROM e),
c AS (SELECT source, lower(line) AS line, count(*) AS pages_with FROM u WHERE NOT regexp_matches(line, '^\s*[0-9]+\s*$') AND length(line) <= 120 GROUP BY 1, 2),
n AS (SELECT source, count(*) AS page_count FROM documents GROUP BY 1)
SELECT source, line, pages_with, page_count FROM c JOIN n USING (source) WHERE pages_with >= CASE WHEN page_count < 8 THEN 2 ELSE 3 END""")
def header_footer_lines(spark, folder):
    docs = table(spark, folder, "documents")
    pages = docs.select("source", "text").select("source", F.transform(lines(F.col("text")), tidy_line).alias("l"))
    counts = docs.groupBy("source").agg(F.count(F.lit(1)).alias("page_count"))
    return keywords.repeated_lines(pages, "source", "l", counts).select("source", "line", "pages_with", "page_count")


@query("body_size_mode", "A19", """
WITH n AS (SELECT p_brand, CAST(round(p_size / 5.0) AS BIGINT) AS size, count(*) AS n FROM part GROUP BY 1, 2)
SELECT p_brand, size FROM n QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, size) = 1""")
def body_size_mode(spark, folder):
    n = table(spark, folder, "part").groupBy("p_brand", F.round(F.col("p_size") / 5.0).cast("bigint").alias("size")).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("p_brand").agg(F.max_by("size", F.struct("n", -F.col("size"))).alias("size"))


@query("severity_counts", "A13", """
SELECT CAST(count_if(event_type = 'error') AS BIGINT) AS high, CAST(count_if(event_type = 'click') AS BIGINT) AS medium,
       CAST(count_if(event_type NOT IN ('error', 'click')) AS BIGINT) AS low, count(*) AS total FROM events""")
def severity_counts(spark, folder):
    kind = F.col("event_type")
    return table(spark, folder, "events").agg(
        F.count_if(kind == "error").alias("high"), F.count_if(kind == "click").alias("medium"),
        F.count_if(~kind.isin("error", "click")).alias("low"), F.count(F.lit(1)).alias("total"))


@query("duplicate_content", "A12", """
WITH h AS (SELECT doc_id, sha256(text) AS file_hash FROM documents)
SELECT h.doc_id, h.file_hash, g.copies FROM h JOIN (SELECT file_hash, count(*) AS copies FROM h GROUP BY 1 HAVING count(*) > 1) g USING (file_hash)""")
def duplicate_content(spark, folder):
    hashed = table(spark, folder, "documents").select("doc_id", content_hash(F.col("text")).alias("file_hash"))
    groups = hashed.groupBy("file_hash").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    return hashed.join(groups, "file_hash").select("doc_id", "file_hash", "copies")


@query("duplicate_paths", "A12", """
SELECT lower(p_name) AS relative_path, count(*) AS copies, min(p_partkey) AS first_id FROM part GROUP BY 1 HAVING count(*) > 1""")
def duplicate_paths(spark, folder):
    return table(spark, folder, "part").groupBy(F.lower("p_name").alias("relative_path")).agg(
        F.count(F.lit(1)).alias("copies"), F.min("p_partkey").alias("first_id")).where("copies > 1")


@query("corpus_snapshot_hash", "A26", """
WITH h AS (SELECT source, sha256(doc_id || ':' || sha256(text)) AS h FROM documents)
SELECT source, sha256(concat_ws(':',
  CAST(sum(('0x' || substr(h, 1, 12))::BIGINT) AS VARCHAR), CAST(sum(('0x' || substr(h, 13, 12))::BIGINT) AS VARCHAR),
  CAST(sum(('0x' || substr(h, 25, 12))::BIGINT) AS VARCHAR), CAST(sum(('0x' || substr(h, 37, 12))::BIGINT) AS VARCHAR),
  CAST(count(*) AS VARCHAR))) AS digest FROM h GROUP BY 1""")
def corpus_snapshot_hash(spark, folder):
    member = F.sha2(F.concat(F.col("doc_id").cast("string"), F.lit(":"), content_hash(F.col("text"))), 256)
    return table(spark, folder, "documents").select("source", member.alias("h")).groupBy("source").agg(set_digest(F.col("h")).alias("digest"))


@query("newest_input_mtime", "A27", "SELECT event_type, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS newest FROM events GROUP BY 1")
def newest_input_mtime(spark, folder):
    return table(spark, folder, "events").groupBy("event_type").agg(F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("newest"))


@query("average_tokens", "A28 X29", "SELECT source, CAST(greatest(sum(length(text) // 4) // count(*), 1) AS BIGINT) AS avg_tokens FROM documents GROUP BY 1")
def average_tokens(spark, folder):
    return table(spark, folder, "documents").groupBy("source").agg(
        F.greatest(F.floor(F.sum(estimated_tokens(F.col("text"))) / F.count(F.lit(1))), F.lit(1)).cast("bigint").alias("avg_tokens"))


SOURCES = """
sources AS (
  SELECT {cluster} AS cluster_id, l_partkey AS material_id, l_discount * 10 AS confidence,
         CASE l_returnflag WHEN 'A' THEN 'High' WHEN 'N' THEN 'medium' ELSE 'low' END AS relevance, l_linenumber AS spans
  FROM lineitem),
weights AS (
  SELECT cluster_id, material_id, round(sum(confidence + CASE lower(relevance) WHEN 'high' THEN 0.5 WHEN 'medium' THEN 0.25 ELSE 0.1 END
         + least(spans, 4) * 0.02), 6) AS weight FROM sources GROUP BY 1, 2)"""


def _weights(spark, folder, cluster):
    rows = table(spark, folder, "lineitem").select(
        F.col(cluster).alias("cluster_id"), F.col("l_partkey").alias("material_id"), (F.col("l_discount") * 10).alias("confidence"),
        F.when(F.col("l_returnflag") == "A", "High").when(F.col("l_returnflag") == "N", "medium").otherwise("low").alias("relevance"),
        F.col("l_linenumber").alias("spans"))
    return evidence.material_weights(rows, RELEVANCE_BONUS)


@query("material_weights", "A7", with_ctes(SOURCES.format(cluster="l_suppkey")) + "SELECT * FROM weights")
def material_weights(spark, folder):
    return _weights(spark, folder, "l_suppkey")


BUDGET = """,
r AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY weight DESC, material_id DESC) AS rn, count(*) OVER (PARTITION BY cluster_id) AS n FROM weights)
SELECT cluster_id, material_id, CAST(CASE WHEN 40 // n > 0 THEN least(4, 40 // n + CASE WHEN rn <= 40 % n THEN 1 ELSE 0 END)
  ELSE CASE WHEN rn <= 40 THEN 1 ELSE 0 END END AS BIGINT) AS chunk_limit FROM r"""


@query("chunk_budget", "A8", with_ctes(SOURCES.format(cluster="l_orderkey")) + BUDGET)
def chunk_budget(spark, folder):
    return evidence.chunk_budget(_weights(spark, folder, "l_orderkey"), 40, 4)


@query("chunk_budget_wide_clusters", "A8", with_ctes(SOURCES.format(cluster="l_suppkey")) + BUDGET)
def chunk_budget_wide_clusters(spark, folder):
    return evidence.chunk_budget(_weights(spark, folder, "l_suppkey"), 40, 4)


@query("cluster_confidence", "A9", "SELECT l_suppkey AS cluster_id, round(greatest(0.0, least(1.0, avg(l_discount * 10))), 6) AS confidence FROM lineitem GROUP BY 1")
def cluster_confidence(spark, folder):
    mean = F.avg(F.col("l_discount") * 10)
    return table(spark, folder, "lineitem").groupBy(F.col("l_suppkey").alias("cluster_id")).agg(
        F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(mean, F.lit(0.0)))), 6).alias("confidence"))


@query("bridge_confidence", "A10", with_ctes(CLUSTERS) + "SELECT bridge_id, round_even(avg(weight), 4) AS confidence FROM clusters GROUP BY 1")
def bridge_confidence(spark, folder):
    return corpus.clusters(spark, folder).groupBy("bridge_id").agg(F.bround(F.avg("weight"), 4).alias("confidence"))
