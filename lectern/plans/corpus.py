"""The document model read from the driver's tables, and the same in SQL.

Every builder is a projection or an in-row explode of one table; none
shuffles. The SQL strings are common table expressions for the twins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.names import singular
from lectern.functions.text import bind, first_line, lines, strip
from lectern.functions.words import char_classes, longest_of_lines


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# ---------------------------------------------------------------- materials

def materials(spark: SparkSession, folder: str) -> DataFrame:
    """documents as materials: domain = lang, collection = source."""
    docs = table(spark, folder, "documents").select("doc_id", "lang", "source", "text")
    return docs.select(
        F.col("doc_id").alias("material_id"),
        F.col("lang").alias("domain"),
        F.col("source").alias("collection"),
        first_line(F.col("text")).alias("title"),
        "text",
    )


MATERIALS = """
materials AS (
  SELECT doc_id AS material_id, lang AS domain, source AS collection,
         trim(string_split(text, chr(10))[1]) AS title, text
  FROM documents)"""


# ------------------------------------------------------------------- chunks

def chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Non-empty lines of a document; long lines of reviewed documents are emphasised."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    labels = table(spark, folder, "labels").where("quality = 1").select("doc_id", F.lit(1).alias("good"))
    exploded = docs.join(labels, "doc_id", "left").select(
        "doc_id", "good", F.posexplode(lines(F.col("text"))).alias("pos", "line")
    )
    return exploded.select(
        F.col("doc_id").alias("material_id"),
        F.format_string("chk_%05d", F.col("pos") + 1).alias("chunk_id"),
        F.format_string("%019d-%019d", "doc_id", "pos").alias("chunk_key"),
        F.col("pos").cast("bigint").alias("pos"),
        strip(F.col("line")).alias("text"),
        (F.col("good").isNotNull() & (F.length("line") >= 200)).alias("emphasized"),
    ).where("text != ''")


CHUNKS = """
raw_lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos
  FROM documents),
chunks AS (
  SELECT r.doc_id AS material_id, format('chk_{:05d}', pos + 1) AS chunk_id,
         format('{:019d}-{:019d}', r.doc_id, pos) AS chunk_key, CAST(pos AS BIGINT) AS pos,
         trim(line) AS text, (l.doc_id IS NOT NULL AND length(line) >= 200) AS emphasized
  FROM raw_lines r LEFT JOIN (SELECT doc_id FROM labels WHERE quality = 1) l ON l.doc_id = r.doc_id
  WHERE trim(line) <> '')"""


# -------------------------------------------------------------- annotations

def annotations(spark: SparkSession, folder: str) -> DataFrame:
    """Conversation turns as a reader's marks; a user's turn carries a comment."""
    return table(spark, folder, "conversations").select(
        F.col("conv_id").alias("material_id"),
        F.col("turn").alias("page"),
        F.concat_ws("-", F.lit("ann"), "conv_id", "turn").alias("annotation_id"),
        F.col("role").alias("type"),
        F.col("text").alias("quoted_text"),
        F.when(F.col("role") == "user", F.col("text")).otherwise("").alias("comment"),
    )


ANNOTATIONS = """
annotations AS (
  SELECT conv_id AS material_id, turn AS page, 'ann-' || conv_id || '-' || turn AS annotation_id,
         role AS type, text AS quoted_text, CASE WHEN role = 'user' THEN text ELSE '' END AS comment
  FROM conversations)"""


# ------------------------------------------------------------------ figures

def figures(spark: SparkSession, folder: str) -> DataFrame:
    """Paragraph blocks of a web page as figure descriptions."""
    pages = table(spark, folder, "pages").select("page_id", "html")
    blocks = pages.select(
        "page_id", F.posexplode(F.regexp_extract_all("html", F.lit("<p>([^<]*)"), F.lit(1))).alias("pos", "description")
    )
    return blocks.select(
        F.col("page_id").alias("material_id"),
        F.format_string("fig_%04d", F.col("pos") + 1).alias("figure_id"),
        F.format_string("%019d-%019d", "page_id", "pos").alias("figure_key"),
        (F.col("pos") + 1).cast("bigint").alias("source_page"),
        F.when(F.length("description") >= 120, "photo").otherwise("diagram").alias("visual_type"),
        F.when(F.length("description") >= 60, "substantive").otherwise("decorative").alias("relevance"),
        F.when(F.length("description") >= 20, F.format_string("figures/%d.png", F.col("pos"))).otherwise("").alias("image_path"),
        "description",
    )


FIGURES = """
raw_figures AS (
  SELECT page_id, unnest(regexp_extract_all(html, '<p>([^<]*)', 1)) AS description,
         generate_subscripts(regexp_extract_all(html, '<p>([^<]*)', 1), 1) - 1 AS pos
  FROM pages),
figures AS (
  SELECT page_id AS material_id, format('fig_{:04d}', pos + 1) AS figure_id,
         format('{:019d}-{:019d}', page_id, pos) AS figure_key, CAST(pos + 1 AS BIGINT) AS source_page,
         CASE WHEN length(description) >= 120 THEN 'photo' ELSE 'diagram' END AS visual_type,
         CASE WHEN length(description) >= 60 THEN 'substantive' ELSE 'decorative' END AS relevance,
         CASE WHEN length(description) >= 20 THEN 'figures/' || pos || '.png' ELSE '' END AS image_path,
         description
  FROM raw_figures)"""


# ----------------------------------------------------------------- concepts

def concepts(spark: SparkSession, folder: str) -> DataFrame:
    """Key terms of a document, the longest word of each of its lines, graded by where they first stand.

    Keyed (material, concept key); the first spelling wins inside the row, so
    no shuffle is needed.
    """
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("material_id"), "text")
    words = F.array_distinct(longest_of_lines(F.col("text"), char_classes(spark)))

    def first_spellings(found):
        """Sort by (key, position) and keep each key's first entry."""
        ordered = F.sort_array(F.transform(found, lambda w, i: F.struct(
            singular(w).alias("concept_key"), i.alias("pos"), w.alias("concept_name"))))
        return bind(ordered, lambda s: F.filter(s, lambda x, i: (i == 0) | (F.get(s, i - 1)["concept_key"] != x["concept_key"])))

    first = bind(words, first_spellings)
    graded = docs
    return graded.select("material_id", F.explode(first).alias("w")).select(
        "material_id", "w.concept_name", "w.concept_key",
        F.col("w.pos").cast("bigint").alias("pos"),
        F.when(F.col("w.pos") < 3, "high").when(F.col("w.pos") < 8, "medium").otherwise("low").alias("relevance"),
    )


CONCEPTS = r"""
raw_words AS (
  SELECT doc_id AS material_id, string_split(text, chr(10)) AS rows FROM documents),
word_lists AS (
  SELECT material_id,
         list_filter(list_transform(rows, lambda r: list_reduce(
           list_concat([''], regexp_extract_all(strip_accents(lower(trim(r))), '[\p{L}\p{N}]+')),
           lambda a, x: CASE WHEN length(x) > length(a) THEN x ELSE a END)), lambda x: x <> '') AS w
  FROM raw_words),
word_rows AS (
  SELECT material_id, unnest(w) AS concept_name, generate_subscripts(w, 1) AS spot FROM word_lists),
firsts AS (
  SELECT material_id, concept_name, min(spot) AS spot FROM word_rows GROUP BY 1, 2),
ranked_words AS (
  SELECT material_id, concept_name, row_number() OVER (PARTITION BY material_id ORDER BY spot) - 1 AS pos FROM firsts),
keyed_words AS (
  SELECT material_id, concept_name,
         CASE WHEN length(concept_name) <= 3 THEN concept_name
              WHEN concept_name LIKE '%ies' AND length(concept_name) > 4 THEN left(concept_name, length(concept_name) - 3) || 'y'
              WHEN regexp_matches(concept_name, '(ses|xes|zes|ches|shes)$') THEN left(concept_name, length(concept_name) - 2)
              WHEN concept_name LIKE '%s' AND NOT regexp_matches(concept_name, '(ss|us|is)$') THEN left(concept_name, length(concept_name) - 1)
              ELSE concept_name END AS concept_key, pos
  FROM ranked_words),
concepts AS (
  SELECT material_id, arg_min(concept_name, pos) AS concept_name, concept_key,
         CAST(min(pos) AS BIGINT) AS pos,
         CASE WHEN min(pos) < 3 THEN 'high' WHEN min(pos) < 8 THEN 'medium' ELSE 'low' END AS relevance
  FROM keyed_words GROUP BY material_id, concept_key)"""


# --------------------------------------------------------- membership graph

def memberships(spark: SparkSession, folder: str) -> DataFrame:
    """(cluster, material) pairs: suppliers as local clusters of parts."""
    return table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("cluster_id"), F.col("l_partkey").alias("material_id")
    ).distinct()


MEMBERSHIPS = """
memberships AS (
  SELECT DISTINCT l_suppkey AS cluster_id, l_partkey AS material_id FROM lineitem)"""


def clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Local clusters with the scope of their nation and region."""
    s, n, r = (table(spark, folder, t) for t in ("supplier", "nation", "region"))
    return (
        s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
        .select(
            F.col("s_suppkey").alias("cluster_id"),
            F.col("s_name").alias("canonical_name"),
            F.lower("r_name").alias("domain"),
            F.lower("n_name").alias("collection"),
            F.col("s_nationkey").alias("bridge_id"),
            F.col("s_acctbal").alias("weight"),
        )
    )


CLUSTERS = """
clusters AS (
  SELECT s_suppkey AS cluster_id, s_name AS canonical_name, lower(r_name) AS domain,
         lower(n_name) AS collection, s_nationkey AS bridge_id, s_acctbal AS weight
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


# --------------------------------------------------------- catalogue items

def catalogue(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as materials with facets: brand is the author, name words are keywords."""
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("material_id"),
        F.col("p_name").alias("title"),
        F.lower("p_brand").alias("author"),
        F.split(F.lower("p_name"), " ").alias("keywords"),
        F.col("p_type").alias("building_type"),
        F.col("p_size").cast("string").alias("scale"),
    )


CATALOGUE = """
catalogue AS (
  SELECT p_partkey AS material_id, p_name AS title, lower(p_brand) AS author,
         string_split(lower(p_name), ' ') AS keywords, p_type AS building_type,
         CAST(p_size AS VARCHAR) AS scale
  FROM part)"""


def with_ctes(*ctes: str) -> str:
    """WITH clause out of the shared fragments."""
    return "WITH " + ",".join(ctes)
