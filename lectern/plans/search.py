"""Search queries over materials, chunks, annotations, figures and concepts."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions.lists import first_text
from lectern.functions.names import bridge_path
from lectern.functions.text import excerpt, lines
from lectern.operators import search as ops
from lectern.operators.ranking import TextTable, best, query_phrases
from lectern.operators.tables import stored
from lectern.plans import corpus
from lectern.plans.corpus import ANNOTATIONS, CHUNKS, CLUSTERS, CONCEPTS, FIGURES, MATERIALS, MEMBERSHIPS, with_ctes
from lectern.plans.indexes import search
from lectern.plans.registry import query
from lectern.session import rounded

ASK = "reer of the inhe mente"


def bm25_cte(name: str, source: str, key: str, fields: list[str], ask: str,
             only: str | None = None, carry: tuple[str, ...] = ()) -> str:
    """SQL twin of the ranking operator as a chain of CTEs ending in ``name``."""
    phrases = query_phrases(ask)
    extra = "".join(f", {c}" for c in carry)
    toks = ", ".join(
        f"regexp_extract_all(strip_accents(lower({f})), '[\\p{{L}}\\p{{N}}]+') AS t_{f}" for f in fields
    )

    def count(field: str, phrase: list[str]) -> str:
        col = f"t_{field}"
        if len(phrase) == 1:
            return f"len(list_filter({col}, lambda x: x = '{phrase[0]}'))"
        test = " AND ".join(f"{col}[i + {k}] = '{w}'" for k, w in enumerate(phrase))
        return f"len(list_filter(range(1, len({col}) - {len(phrase)} + 2), lambda i: {test}))"

    use = [only] if only else fields
    tfs = ", ".join(
        "(" + " + ".join(count(f, p) for f in use) + f") AS tf{i}" for i, p in enumerate(phrases)
    )
    length = " + ".join(f"len(t_{f})" for f in fields)
    dfs = ", ".join(f"count_if(tf{i} > 0) AS df{i}" for i in range(len(phrases)))

    def part(i: int) -> str:
        idf = f"ln((n - df{i} + 0.5) / (df{i} + 0.5))"
        return (
            f"(CASE WHEN {idf} <= 0 THEN 1e-6 ELSE {idf} END) * tf{i} * 2.2 / "
            f"(tf{i} + 1.2 * (1 - 0.75 + 0.75 * len_all / avg_len))"
        )

    total = " + ".join(part(i) for i in range(len(phrases)))
    any_hit = " OR ".join(f"tf{i} > 0" for i in range(len(phrases)))
    return f"""
{name}_t AS (SELECT {key}{extra}, {toks} FROM {source}),
{name}_c AS (SELECT {key}{extra}, {length} AS len_all, {tfs} FROM {name}_t),
{name}_s AS (SELECT count(*) AS n, avg(len_all) AS avg_len, {dfs} FROM {name}_c),
{name} AS (SELECT {key}{extra}, {total} AS score FROM {name}_c, {name}_s WHERE {any_hit})"""


def material_table(spark, folder):
    rows = corpus.materials(spark, folder)
    return TextTable(rows, "material_id", ("title", "text"), ("domain", "collection"))


def chunk_table(spark, folder):
    rows = corpus.chunks(spark, folder)
    return TextTable(rows, "chunk_key", ("text",), ("material_id", "chunk_id", "emphasized"))


def annotation_table(spark, folder):
    rows = corpus.annotations(spark, folder)
    return TextTable(rows, "annotation_id", ("quoted_text", "comment"), ("material_id", "comment", "page", "type"))


def figure_table(spark, folder):
    rows = corpus.figures(spark, folder)
    return TextTable(rows, "figure_key", ("description",), ("material_id", "figure_id", "visual_type"))


def concept_table(spark, folder):
    rows = corpus.concepts(spark, folder)
    return TextTable(
        rows.withColumn("concept_row", F.concat_ws("/", "material_id", "concept_key")),
        "concept_row", ("concept_name",), ("material_id", "concept_name", "relevance"), derived=True,
    )


CARD_HITS = bm25_cte("hits", "materials", "material_id", ["title", "text"], ASK, carry=("domain", "collection"))
CHUNK_HITS = bm25_cte("chunk_hits", "chunks", "chunk_key", ["text"], ASK, carry=("material_id", "chunk_id", "emphasized"))
ANN_HITS = bm25_cte("ann_hits", "annotations", "annotation_id", ["quoted_text", "comment"], ASK, carry=("material_id", "comment", "page", "type"))
FIG_HITS = bm25_cte("fig_hits", "figures", "figure_key", ["description"], ASK, carry=("material_id", "figure_id", "visual_type"))
CONCEPT_ROWS = CONCEPTS + """,
concept_rows AS (SELECT *, material_id || '/' || concept_key AS concept_row FROM concepts)"""
CONCEPT_HITS = bm25_cte("concept_hits", "concept_rows", "concept_row", ["concept_name"], ASK, carry=("material_id", "concept_name", "relevance"))


def top_sql(source: str, key: str, limit: int, columns: str = "") -> str:
    return (
        f"SELECT {key}{columns}, round(score, 6) AS score, "
        f"row_number() OVER (ORDER BY score DESC, {key}) AS rank FROM {source} "
        f"ORDER BY score DESC, {key} LIMIT {limit}"
    )


def _cards(hits, limit=20):
    ranked = ops.cards(hits, "material_id", limit)
    return ranked.select("material_id", "domain", "collection", rounded(F.col("score")).alias("score"), "rank")


CARD_COLUMNS = ", domain, collection"


@query("search_cards_bm25", "W1 O1 F5 J1 X1", with_ctes(MATERIALS, CARD_HITS) + top_sql("hits", "material_id", 20, CARD_COLUMNS))
def search_cards_bm25(spark, folder):
    return _cards(search(spark, "materials", material_table(spark, folder), query_phrases(ASK)))


@query("search_cards_stemmed", "W1", None)
def search_cards_stemmed(spark, folder):
    """Cards are indexed by stem: any inflection of a query word matches."""
    rows = corpus.materials(spark, folder)
    stems = TextTable(rows, "material_id", ("title", "text"), ("domain", "collection"), stemmed=True)
    return _cards(search(spark, "stems", stems, query_phrases("licensing hatedness relational")))


SEVEN = """
seven AS (
  SELECT doc_id AS material_id, lang AS domain, source AS collection, trim(l[1]) AS title, coalesce(l[2], '') AS summary,
    lang || ' ' || source AS keywords, coalesce(regexp_replace(lower(l[3]), '[^a-z]+', ' ', 'g'), '') AS raw_keywords, source AS authors,
    coalesce(l[len(l)], '') AS methodological_conclusions, array_to_string(l[4:], ' ') AS main_content_learnings
  FROM (SELECT *, string_split(text, chr(10)) AS l FROM documents))"""
#: The indexed columns of a card.
CARD_FIELDS = ("title", "summary", "keywords", "raw_keywords", "authors", "methodological_conclusions", "main_content_learnings")


def seven_columns(spark, folder, stemmed=False):
    """Cards with all indexed columns: lines of a document in the places of its summary, conclusions and learnings."""
    docs = corpus.table(spark, folder, "documents").select(
        F.col("doc_id").alias("material_id"), F.col("lang").alias("domain"), F.col("source").alias("collection"), lines(F.col("text")).alias("l"))
    line = lambda i: F.coalesce(F.get("l", F.lit(i)), F.lit(""))
    rows = docs.select(
        "material_id", "domain", "collection", F.trim(line(0)).alias("title"), line(1).alias("summary"), F.concat_ws(" ", "domain", "collection").alias("keywords"),
        F.regexp_replace(F.lower(line(2)), "[^a-z]+", " ").alias("raw_keywords"), F.col("collection").alias("authors"),
        F.coalesce(F.element_at("l", -1), F.lit("")).alias("methodological_conclusions"),
        F.array_join(F.slice("l", 4, F.greatest(F.size("l"), F.lit(1))), " ").alias("main_content_learnings"))
    return TextTable(rows, "material_id", CARD_FIELDS, ("domain", "collection"), stemmed=stemmed)


SEVEN_HITS = bm25_cte("hits", "seven", "material_id", list(CARD_FIELDS), "src7 inhe mente of", carry=("domain", "collection"))


@query("search_seven_columns", "W1 J1 F5", with_ctes(SEVEN, SEVEN_HITS) + top_sql("hits", "material_id", 20, CARD_COLUMNS))
def search_seven_columns(spark, folder):
    """Cards ranked over their seven indexed columns."""
    return _cards(search(spark, "cards", seven_columns(spark, folder), query_phrases("src7 inhe mente of")))


@query("search_seven_columns_phrase", "W1 X1 F3", with_ctes(SEVEN, bm25_cte(
    "hits", "seven", "material_id", list(CARD_FIELDS), '"of the"', only="main_content_learnings", carry=("domain", "collection"))) + top_sql("hits", "material_id", 20, CARD_COLUMNS))
def search_seven_columns_phrase(spark, folder):
    """A phrase in one of the seven columns, from the places of its words."""
    return _cards(search(spark, "cards", seven_columns(spark, folder), query_phrases('"of the"'), "main_content_learnings"))


@query("search_faceted_exact", "F1 F2", with_ctes(MATERIALS, CARD_HITS) + top_sql(
    "(SELECT * FROM hits WHERE domain = 'en' AND collection = 'src7')", "material_id", 20, CARD_COLUMNS))
def search_faceted_exact(spark, folder):
    hits = search(spark, "materials", material_table(spark, folder), query_phrases(ASK))
    wanted = ops.facet_filter(["domain==en", "collection==src7", "colour==red"])
    return _cards(hits.where(wanted))


@query("search_faceted_contains", "F1 F2 X2", with_ctes(MATERIALS, CARD_HITS) + top_sql(
    "(SELECT * FROM hits WHERE lower(domain) LIKE '%e%' AND lower(collection) LIKE '%c1%')", "material_id", 20, CARD_COLUMNS))
def search_faceted_contains(spark, folder):
    hits = search(spark, "materials", material_table(spark, folder), query_phrases(ASK))
    return _cards(hits.where(ops.facet_filter(["domain=E"], collection="c1")))


@query("search_scoped_ids", "F4", with_ctes(MATERIALS, CARD_HITS) + top_sql(
    "(SELECT * FROM hits WHERE material_id IN (SELECT doc_id FROM labels WHERE quality = 1))", "material_id", 20, CARD_COLUMNS))
def search_scoped_ids(spark, folder):
    scope = corpus.table(spark, folder, "labels").where("quality = 1").select(F.col("doc_id").alias("material_id"))
    hits = search(spark, "materials", material_table(spark, folder), query_phrases(ASK))
    return _cards(hits.join(scope, "material_id", "left_semi"))


@query("search_phrase", "X1 F5", with_ctes(MATERIALS, bm25_cte(
    "hits", "materials", "material_id", ["title", "text"], '"of the"', carry=("domain", "collection"))) + top_sql("hits", "material_id", 20, CARD_COLUMNS))
def search_phrase(spark, folder):
    return _cards(search(spark, "materials", material_table(spark, folder), query_phrases('"of the"')))


@query("search_title_scope", "F3", with_ctes(MATERIALS, bm25_cte(
    "hits", "materials", "material_id", ["title", "text"], ASK, only="title", carry=("domain", "collection"))) + top_sql("hits", "material_id", 20, CARD_COLUMNS))
def search_title_scope(spark, folder):
    return _cards(search(spark, "materials", material_table(spark, folder), query_phrases(ASK), only="title"))


@query("search_stopword_only", "X1", with_ctes(MATERIALS, bm25_cte(
    "hits", "materials", "material_id", ["title", "text"], "that the", carry=("domain", "collection"))) + top_sql("hits", "material_id", 20, CARD_COLUMNS))
def search_stopword_only(spark, folder):
    return _cards(search(spark, "materials", material_table(spark, folder), query_phrases("that the")))


@query("search_hyphenated", "X1", with_ctes(MATERIALS, bm25_cte(
    "hits", "materials", "material_id", ["title", "text"], "in-the", carry=("domain", "collection"))) + top_sql("hits", "material_id", 20, CARD_COLUMNS))
def search_hyphenated(spark, folder):
    return _cards(search(spark, "materials", material_table(spark, folder), query_phrases("in-the")))


@query("search_empty_query", "X1", "SELECT doc_id AS material_id, lang AS domain, source AS collection, CAST(0 AS DOUBLE) AS score, CAST(0 AS BIGINT) AS rank FROM documents WHERE false")
def search_empty_query(spark, folder):
    return _cards(search(spark, "materials", material_table(spark, folder), query_phrases("   ")))


@query("search_project_scope", "F18 F19", with_ctes(MATERIALS, CARD_HITS) + top_sql(
    "(SELECT * FROM hits WHERE domain = 'fr' AND lower(collection) LIKE '%src1%')", "material_id", 20, CARD_COLUMNS))
def search_project_scope(spark, folder):
    hits = search(spark, "materials", material_table(spark, folder), query_phrases(ASK))
    facets = ops.facets_in_domain(["domain==en"], "fr")
    return _cards(hits.where(ops.facet_filter(facets, collection="src1")))


# -------------------------------------------------- evidence inside materials

@query("chunk_topk_emphasis", "W2 J2 P5", with_ctes(CHUNKS, CHUNK_HITS) + """
SELECT material_id, chunk_id, emphasized, round(score, 6) AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY material_id
    ORDER BY score + CASE WHEN emphasized THEN 0.2 ELSE 0 END DESC, chunk_key) AS rank FROM chunk_hits)
WHERE rank <= 5""")
def chunk_topk_emphasis(spark, folder):
    hits = search(spark, "chunks", chunk_table(spark, folder), query_phrases(ASK))
    top = ops.top_chunks(hits, "material_id", "chunk_key", 5)
    return top.select("material_id", "chunk_id", "emphasized", rounded(F.col("score")).alias("score"), "rank")


@query("annotation_topk_commented_first", "W3 J2", with_ctes(ANNOTATIONS, ANN_HITS) + """
SELECT material_id, annotation_id, type, round(score, 6) AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY material_id
    ORDER BY CASE WHEN comment = '' THEN 1 ELSE 0 END, score DESC, annotation_id) AS rank FROM ann_hits)
WHERE rank <= 3""")
def annotation_topk_commented_first(spark, folder):
    hits = search(spark, "annotations", annotation_table(spark, folder), query_phrases(ASK))
    top = ops.top_annotations(hits, "material_id", "annotation_id", 3)
    return top.select("material_id", "annotation_id", "type", rounded(F.col("score")).alias("score"), "rank")


@query("figure_topk", "W4 J2", with_ctes(FIGURES, FIG_HITS) + """
SELECT material_id, figure_id, visual_type, round(score, 6) AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY material_id ORDER BY score DESC, figure_key) AS rank FROM fig_hits)
WHERE rank <= 3""")
def figure_topk(spark, folder):
    hits = search(spark, "figures", figure_table(spark, folder), query_phrases(ASK))
    top = ops.top_plain(hits, "material_id", "figure_key", 3)
    return top.select("material_id", "figure_id", "visual_type", rounded(F.col("score")).alias("score"), "rank")


TERMS = "thanedble licensed therhean"
TERM_HITS = bm25_cte("concept_hits", "concept_rows", "concept_row", ["concept_name"], TERMS, carry=("material_id", "concept_name", "relevance"))


@query("concept_topk", "W4 J2", with_ctes(CONCEPT_ROWS, TERM_HITS) + """
SELECT material_id, concept_name, relevance, round(score, 6) AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY material_id ORDER BY score DESC, concept_row) AS rank FROM concept_hits)
WHERE rank <= 3""")
def concept_topk(spark, folder):
    hits = search(spark, "concepts", concept_table(spark, folder), query_phrases(TERMS))
    top = ops.top_plain(hits, "material_id", "concept_row", 3)
    return top.select("material_id", "concept_name", "relevance", rounded(F.col("score")).alias("score"), "rank")


@query("material_evidence", "G26", with_ctes(CHUNKS, CHUNK_HITS, ANNOTATIONS, ANN_HITS) + """
SELECT 'chunk' AS kind, chunk_id AS evidence_id, round(score, 6) AS score, rank FROM (
  SELECT *, row_number() OVER (ORDER BY score + CASE WHEN emphasized THEN 0.2 ELSE 0 END DESC, chunk_key) AS rank
  FROM chunk_hits WHERE material_id = 110) WHERE rank <= 5
UNION ALL
SELECT 'annotation', annotation_id, round(score, 6), rank FROM (
  SELECT *, row_number() OVER (ORDER BY CASE WHEN comment = '' THEN 1 ELSE 0 END, score DESC, annotation_id) AS rank
  FROM ann_hits WHERE material_id = 110) WHERE rank <= 3""")
def material_evidence(spark, folder):
    one = F.col("material_id") == 110
    chunk = ops.top_chunks(search(spark, "chunks", chunk_table(spark, folder), query_phrases(ASK)).where(one), "material_id", "chunk_key", 5)
    note = ops.top_annotations(search(spark, "annotations", annotation_table(spark, folder), query_phrases(ASK)).where(one), "material_id", "annotation_id", 3)
    return chunk.select(F.lit("chunk").alias("kind"), F.col("chunk_id").alias("evidence_id"), rounded(F.col("score")).alias("score"), "rank").unionByName(
        note.select(F.lit("annotation").alias("kind"), F.col("annotation_id").alias("evidence_id"), rounded(F.col("score")).alias("score"), "rank"))


CANDIDATES = """
candidate_sources AS (
  SELECT material_id, 0 AS src FROM (SELECT DISTINCT material_id FROM chunk_hits ORDER BY 1 LIMIT 20)
  UNION ALL SELECT material_id, 1 FROM (SELECT DISTINCT material_id FROM ann_hits ORDER BY 1 LIMIT 20)
  UNION ALL SELECT material_id, 2 FROM (SELECT DISTINCT material_id FROM fig_hits ORDER BY 1 LIMIT 20)
  UNION ALL SELECT material_id, 3 FROM (SELECT DISTINCT material_id FROM concept_hits ORDER BY 1 LIMIT 20)),
candidates AS (
  SELECT material_id, source_order, row_number() OVER (ORDER BY source_order, material_id) AS position
  FROM (SELECT material_id, min(src) AS source_order FROM candidate_sources GROUP BY 1))"""
ALL_HITS = (CHUNKS, CHUNK_HITS, ANNOTATIONS, ANN_HITS, FIGURES, FIG_HITS, CONCEPT_ROWS, CONCEPT_HITS)


def content_sources(spark, folder):
    phrases = query_phrases(ASK)
    tables = {"chunks": chunk_table, "annotations": annotation_table, "figures": figure_table, "concepts": concept_table}
    return [search(spark, name, build(spark, folder), phrases) for name, build in tables.items()]


@query("content_first_candidates", "W6 U1", with_ctes(*ALL_HITS, CANDIDATES) +
       "SELECT material_id, CAST(source_order AS INTEGER) AS source_order, position FROM candidates")
def content_first_candidates(spark, folder):
    return ops.content_candidates(content_sources(spark, folder), "material_id", 20)


def content_tops(spark, folder):
    """Each source's truncated hits; they name the same materials as all hits."""
    chunk, note, figure, concept = content_sources(spark, folder)
    return [
        ops.top_chunks(chunk.select("material_id", "chunk_key", "emphasized", "score"), "material_id", "chunk_key", 5),
        ops.top_annotations(note.select("material_id", "annotation_id", "comment", "score"), "material_id", "annotation_id", 3),
        ops.top_plain(figure.select("material_id", "figure_key", "score"), "material_id", "figure_key", 3),
        ops.top_plain(concept.select("material_id", "concept_row", "score"), "material_id", "concept_row", 3),
    ]


ORDERED = """
cards AS (
  SELECT material_id, row_number() OVER (ORDER BY score DESC, material_id) AS rank FROM (
    SELECT * FROM hits {where} ORDER BY score DESC, material_id LIMIT 20)),
ordered AS (
  SELECT material_id, row_number() OVER (ORDER BY late, spot) AS ordinal FROM (
    SELECT material_id, 0 AS late, rank AS spot FROM cards
    UNION ALL
    SELECT material_id, 1, position FROM candidates
    WHERE material_id NOT IN (SELECT material_id FROM cards)
      AND material_id IN (SELECT material_id FROM materials {where})))"""


@query("content_first_limit_then_filter", "W6 H43", with_ctes(
    MATERIALS, CARD_HITS, *ALL_HITS, CANDIDATES, ORDERED.format(where="WHERE domain = 'en'")) + "SELECT * FROM ordered")
def content_first_limit_then_filter(spark, folder):
    in_domain = ops.facet_filter(["domain==en"])
    card_rows = ops.cards(search(spark, "materials", material_table(spark, folder), query_phrases(ASK)).where(in_domain), "material_id", 20)
    found = ops.content_candidates(content_sources(spark, folder), "material_id", 20)
    allowed = corpus.materials(spark, folder).where(in_domain)
    return ops.append_content(card_rows, found, allowed, "material_id")


@query("rerank_evidence", "W5", with_ctes(
    MATERIALS, CARD_HITS, *ALL_HITS, CANDIDATES, ORDERED.format(where=""), """
boosts AS (
  SELECT material_id, 0.2 AS boost FROM (
    SELECT *, row_number() OVER (PARTITION BY material_id ORDER BY score + CASE WHEN emphasized THEN 0.2 ELSE 0 END DESC, chunk_key) AS rank FROM chunk_hits)
  WHERE rank <= 5 AND emphasized
  UNION ALL
  SELECT material_id, CASE WHEN comment <> '' THEN 0.8 ELSE 0.5 END FROM (
    SELECT *, row_number() OVER (PARTITION BY material_id ORDER BY CASE WHEN comment = '' THEN 1 ELSE 0 END, score DESC, annotation_id) AS rank FROM ann_hits)
  WHERE rank <= 3
  UNION ALL
  SELECT material_id, 0.3 FROM (
    SELECT *, row_number() OVER (PARTITION BY material_id ORDER BY score DESC, concept_row) AS rank FROM concept_hits)
  WHERE rank <= 3),
scored AS (
  SELECT material_id, ordinal, round(CAST(ordinal - coalesce(b.boost, 0) AS DOUBLE), 6) AS priority
  FROM ordered LEFT JOIN (SELECT material_id, sum(CAST(boost AS DOUBLE)) AS boost FROM boosts GROUP BY 1) b USING (material_id))""") +
       "SELECT *, row_number() OVER (ORDER BY priority, ordinal) AS rank FROM scored")
def rerank_evidence(spark, folder):
    # each source's hits name candidates and boost them: they are found and cut once, and the plan holds none of it
    chunk_top, note_top, figure_top, concept_top = (stored(top, "tops") for top in content_tops(spark, folder))
    card_rows = ops.cards(search(spark, "materials", material_table(spark, folder), query_phrases(ASK)), "material_id", 20)
    found = ops.content_candidates([chunk_top, note_top, figure_top, concept_top], "material_id", 20)
    ordered = ops.append_content(card_rows, found, corpus.materials(spark, folder), "material_id")
    return ops.rerank(ordered, chunk_top, note_top, concept_top, "material_id")


# ------------------------------------------------- collections and clusters

@query("like_fallback_union", "F6 U2 H42", with_ctes(MATERIALS, bm25_cte(
    "hits", "materials", "material_id", ["title"], "erblest heon", carry=("domain",)), """
fallback AS (
  SELECT material_id, domain FROM materials
  WHERE lower(title) LIKE '%heonth%' OR lower(collection) LIKE '%heonth%'),
both_rows AS (
  SELECT material_id, domain, 0 AS late, row_number() OVER (ORDER BY score DESC, material_id) AS spot FROM hits
  UNION ALL
  SELECT material_id, domain, 1, row_number() OVER (ORDER BY domain, material_id) FROM fallback),
cut AS (SELECT * FROM both_rows WHERE spot <= 30),
one AS (SELECT *, row_number() OVER (PARTITION BY material_id ORDER BY late, spot) AS n FROM cut),
numbered AS (SELECT *, row_number() OVER (ORDER BY late, spot) AS rank FROM one WHERE n = 1)""") + """
SELECT material_id, domain, rank, CASE WHEN late = 0 THEN 'terms' ELSE 'substring' END AS matched_by
FROM numbered WHERE rank <= 30""")
def like_fallback_union(spark, folder):
    rows = corpus.materials(spark, folder)
    hits = search(spark, "titles", TextTable(rows, "material_id", ("title",), ("domain",)), query_phrases("erblest heon"))
    fallback = rows.where(ops.like_any([F.col("title"), F.col("collection")], "heonth")).select("material_id", "domain")
    key = F.col("material_id").asc()
    merged = ops.hits_then_fallback(
        hits, fallback, "material_id", 30, [F.col("score").desc(), key], [F.col("domain").asc(), key])
    return merged.select("material_id", "domain", "rank", "matched_by")


@query("collection_pages_search", "J5 P6", """
WITH counts AS (SELECT lang AS domain, source AS collection, count(*) AS material_count FROM documents GROUP BY 1, 2),
reflections AS (
  SELECT lang AS domain, source AS collection, 'wiki/' || lang || '/' || source || '/_index.md' AS wiki_path,
         max(CASE WHEN l.toxic = 1 THEN 'disputed collection' ELSE '' END) AS why
  FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE l.quality = 1 GROUP BY 1, 2)
SELECT c.domain, c.collection, c.domain || ' / ' || c.collection AS title,
       coalesce(r.wiki_path, 'wiki/' || c.domain || '/' || c.collection || '/_index.md') AS wiki_path,
       c.material_count, coalesce(r.why, '') AS summary
FROM counts c LEFT JOIN reflections r ON r.domain = c.domain AND r.collection = c.collection
WHERE lower(c.domain) LIKE '%rc1%' OR lower(c.collection) LIKE '%rc1%' OR lower(coalesce(r.why, '')) LIKE '%rc1%'
ORDER BY c.material_count DESC, c.domain, c.collection LIMIT 20""")
def collection_pages_search(spark, folder):
    docs = corpus.table(spark, folder, "documents").select("doc_id", F.col("lang").alias("domain"), F.col("source").alias("collection"))
    counts = docs.groupBy("domain", "collection").agg(F.count(F.lit(1)).alias("material_count"))
    labels = corpus.table(spark, folder, "labels").where("quality = 1")
    reflections = docs.join(labels, "doc_id").groupBy("domain", "collection").agg(
        F.max(F.when(F.col("toxic") == 1, "disputed collection").otherwise("")).alias("why")
    ).withColumn("wiki_path", F.concat(F.lit("wiki/"), "domain", F.lit("/"), "collection", F.lit("/_index.md")))
    joined = counts.join(reflections, ["domain", "collection"], "left")
    found = joined.where(ops.like_any([F.col("domain"), F.col("collection"), F.col("why")], "rc1"))
    default_path = F.concat(F.lit("wiki/"), "domain", F.lit("/"), "collection", F.lit("/_index.md"))
    return found.orderBy(F.desc("material_count"), "domain", "collection").limit(20).select(
        "domain", "collection", F.concat("domain", F.lit(" / "), "collection").alias("title"),
        F.coalesce("wiki_path", default_path).alias("wiki_path"), "material_count",
        first_text(F.col("why")).alias("summary"))


CLUSTER_NOTES = """
cluster_notes AS (
  SELECT s_suppkey AS cluster_id, CASE WHEN s_acctbal > 5000 THEN 'strong balance ' || s_name ELSE '' END AS why,
         CASE WHEN s_acctbal > 0 THEN 'credit of ' || s_name ELSE '' END AS takeaway
  FROM supplier WHERE s_acctbal > -500)"""


def cluster_notes(spark, folder):
    s = corpus.table(spark, folder, "supplier").where("s_acctbal > -500")
    return s.select(
        F.col("s_suppkey").alias("cluster_id"),
        F.when(F.col("s_acctbal") > 5000, F.concat(F.lit("strong balance "), "s_name")).otherwise("").alias("why"),
        F.when(F.col("s_acctbal") > 0, F.concat(F.lit("credit of "), "s_name")).otherwise("").alias("takeaway"))


@query("cluster_search_left_reflection", "J3 P6", with_ctes(CLUSTERS, CLUSTER_NOTES, bm25_cte(
    "hits", "clusters", "cluster_id", ["canonical_name", "collection"], "nation_7 supplier", carry=("domain", "canonical_name"))) + """
SELECT h.cluster_id, h.canonical_name, h.domain, round(score, 6) AS score,
       coalesce(nullif(trim(n.why), ''), nullif(trim(n.takeaway), ''), '') AS summary
FROM hits h LEFT JOIN cluster_notes n ON n.cluster_id = h.cluster_id
ORDER BY h.score DESC, h.cluster_id LIMIT 50""")
def cluster_search_left_reflection(spark, folder):
    rows = corpus.clusters(spark, folder)
    names = TextTable(rows, "cluster_id", ("canonical_name", "collection"), ("domain", "canonical_name"))
    hits = search(spark, "clusters", names, query_phrases("nation_7 supplier"))
    top = hits.orderBy(F.desc("score"), "cluster_id").limit(50)
    return top.join(cluster_notes(spark, folder), "cluster_id", "left").select(
        "cluster_id", "canonical_name", "domain", rounded(F.col("score")).alias("score"),
        first_text(F.col("why"), F.col("takeaway")).alias("summary"))


@query("cluster_reflection_like", "J4 F6", with_ctes(CLUSTERS, CLUSTER_NOTES, MEMBERSHIPS) + """,
counts AS (SELECT cluster_id, count(*) AS material_count FROM memberships GROUP BY 1)
SELECT c.cluster_id, c.canonical_name, m.material_count
FROM cluster_notes n JOIN clusters c ON c.cluster_id = n.cluster_id JOIN counts m ON m.cluster_id = c.cluster_id
WHERE lower(n.why) LIKE '%strong%#0%' OR lower(n.takeaway) LIKE '%strong%#0%'
ORDER BY m.material_count DESC, c.canonical_name LIMIT 20""")
def cluster_reflection_like(spark, folder):
    notes = cluster_notes(spark, folder).where(ops.like_any([F.col("why"), F.col("takeaway")], "strong%#0"))
    counts = corpus.memberships(spark, folder).groupBy("cluster_id").agg(F.count(F.lit(1)).alias("material_count"))
    return (
        notes.join(corpus.clusters(spark, folder), "cluster_id").join(counts, "cluster_id")
        .select("cluster_id", "canonical_name", "material_count")
        .orderBy(F.desc("material_count"), "canonical_name").limit(20))


@query("bridge_search", "P7 P11 U2", with_ctes(CLUSTERS) + """,
bridges AS (
  SELECT bridge_id, min(domain) AS domain, min(collection) AS canonical_name, count(*) AS members, max(weight) AS best
  FROM clusters GROUP BY bridge_id)
SELECT bridge_id, canonical_name, members,
       CASE WHEN best > 9000 THEN 'holds a large member' ELSE 'bridge of ' || members || ' clusters' END AS summary,
       'wiki/' || domain || '/bridge-concepts/' || canonical_name || '.md' AS wiki_path
FROM bridges WHERE lower(canonical_name) LIKE '%nation_1%' OR lower(domain) LIKE '%nation_1%'
ORDER BY members DESC, canonical_name LIMIT 20""")
def bridge_search(spark, folder):
    bridges = corpus.clusters(spark, folder).groupBy("bridge_id").agg(
        F.min("domain").alias("domain"), F.min("collection").alias("canonical_name"),
        F.count(F.lit(1)).alias("members"), F.max("weight").alias("best"))
    found = bridges.where(ops.like_any([F.col("canonical_name"), F.col("domain")], "nation_1"))
    why = F.when(F.col("best") > 9000, "holds a large member").otherwise("")
    descriptor = F.concat(F.lit("bridge of "), F.col("members").cast("string"), F.lit(" clusters"))
    return found.orderBy(F.desc("members"), "canonical_name").limit(20).select(
        "bridge_id", "canonical_name", "members", first_text(why, descriptor).alias("summary"),
        bridge_path(F.col("domain"), F.col("canonical_name")).alias("wiki_path"))


@query("excerpt_windows", "X26", r"""
WITH c AS (
  SELECT doc_id, trim(regexp_replace(text, '[\s\p{Z}]+', ' ', 'g')) AS body FROM documents),
p AS (
  SELECT doc_id, body, length(body) AS n,
         least(nullif(strpos(lower(body), 'mente'), 0), nullif(strpos(lower(body), 'thorat'), 0)) AS spot FROM c),
w AS (
  SELECT *, coalesce(greatest(spot - 91, 0), 0) AS s0 FROM p),
x AS (SELECT *, least(n, s0 + 260) AS e FROM w),
y AS (SELECT *, greatest(0, e - 260) AS s FROM x)
SELECT doc_id,
       CASE WHEN body = '' THEN '' ELSE
       CASE WHEN s > 0 THEN '...' ELSE '' END ||
       regexp_replace(replace(replace(replace(trim(substr(body, s + 1, e - s)), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'),
                      '(?i)(thorat|mente)', '<mark>\1</mark>', 'g') ||
       CASE WHEN e < n THEN '...' ELSE '' END END AS excerpt
FROM y""")
def excerpt_windows(spark, folder):
    docs = corpus.table(spark, folder, "documents").select("doc_id", "text")
    return docs.select("doc_id", excerpt(F.col("text"), "mente thorat").alias("excerpt"))


@query("card_projection", "P4 O1", with_ctes(MATERIALS, CARD_HITS) + """,
top AS (SELECT material_id, score, row_number() OVER (ORDER BY score DESC, material_id) AS rank
        FROM hits ORDER BY score DESC, material_id LIMIT 20)
SELECT m.material_id, m.title, m.domain || ', ' || m.collection AS authors, t.rank
FROM top t JOIN materials m USING (material_id)""")
def card_projection(spark, folder):
    """Rank on narrow rows first; wide card columns join only the top rows."""
    hits = search(spark, "materials", material_table(spark, folder), query_phrases(ASK)).select("material_id", "score")
    top = best(hits, 20, F.desc("score"), F.asc("material_id")).select("material_id", "rank")
    wide = corpus.materials(spark, folder).select("material_id", "title", "domain", "collection")
    return wide.join(top, "material_id").select(
        "material_id", "title", F.array_join(F.array("domain", "collection"), ", ").alias("authors"), "rank")
