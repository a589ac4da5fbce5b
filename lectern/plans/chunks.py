"""Chunking, batching and annotation overlap."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions.text import bind, estimated_tokens, lines, strip
from lectern.operators import overlap, packing
from lectern.plans.corpus import table, with_ctes
from lectern.plans.registry import query

FOLD = """
paras AS (
  SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS p FROM documents),
folded AS (
  SELECT doc_id, p, list_reduce(
    list_transform(p, lambda x: {{'cur': CAST({size} AS BIGINT), 'n': CAST(0 AS BIGINT), 'out': CAST([] AS BIGINT[])}}),
    lambda a, x: CASE WHEN a['n'] = 0 OR {full}
      THEN {{'cur': x['cur'] + {gap}, 'n': a['n'] + 1, 'out': list_append(a['out'], a['n'] + 1)}}
      ELSE {{'cur': a['cur'] + x['cur'] + {gap}, 'n': a['n'], 'out': list_append(a['out'], a['n'])}} END,
    {{'cur': CAST(0 AS BIGINT), 'n': CAST(0 AS BIGINT), 'out': CAST([] AS BIGINT[])}})['out'] AS g FROM paras),
grouped AS (
  SELECT doc_id, unnest(p) AS para, unnest(g) AS n, generate_subscripts(p, 1) AS i FROM folded WHERE len(p) > 0),
pieces AS (SELECT doc_id, n, string_agg(para, chr(10) || chr(10) ORDER BY i) AS text, count(*) AS paragraphs FROM grouped GROUP BY 1, 2)"""
CHUNK_FOLD = FOLD.format(size="length(x)", full="a['cur'] + x['cur'] + 1 > 2000", gap=2)


def _paragraphs(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    cleaned = F.filter(F.transform(lines(F.col("text")), strip), lambda x: x != "")
    return docs.select("doc_id", cleaned.alias("p"))


def _chunks(spark, folder):
    return _paragraphs(spark, folder).select("doc_id", F.posexplode(packing.chunks(F.col("p"))).alias("n", "text"))


@query("chunk_greedy", "W7 W8", with_ctes(CHUNK_FOLD) + "SELECT doc_id, format('chk_{:05d}', n) AS chunk_id, text FROM pieces")
def chunk_greedy(spark, folder):
    return _chunks(spark, folder).select("doc_id", F.format_string("chk_%05d", F.col("n") + 1).alias("chunk_id"), "text")


@query("page_packing", "S10", with_ctes(FOLD.format(size="length(x)", full="a['cur'] + x['cur'] + CASE WHEN a['n'] = 1 THEN 2 ELSE 0 END > 4000", gap=2)) +
       "SELECT doc_id, n AS page, text FROM pieces")
def page_packing(spark, folder):
    packed = _paragraphs(spark, folder).select("doc_id", F.posexplode(packing.pages(F.col("p"))).alias("n", "text"))
    return packed.select("doc_id", (F.col("n") + 1).cast("bigint").alias("page"), "text")


@query("token_batches", "W9 A28", with_ctes(FOLD.format(
    size="length(x) // 4", full="a['cur'] + x['cur'] > 160", gap=0)) +
       "SELECT doc_id, n AS batch, paragraphs AS pieces FROM pieces")
def token_batches(spark, folder):
    starts = bind(F.col("p"), lambda p: packing.split_at(p, packing.token_batches(F.transform(p, estimated_tokens), F.lit(160))))
    return _paragraphs(spark, folder).select("doc_id", F.posexplode(starts).alias("n", "g")).select(
        "doc_id", (F.col("n") + 1).cast("bigint").alias("batch"), F.size("g").cast("bigint").alias("pieces"))


@query("packet_parts", "G23", with_ctes(FOLD.format(
    size="strlen(x)", full="a['cur'] + x['cur'] > 45000", gap=0)) + """
SELECT d.doc_id, coalesce(n, 0) AS parts FROM documents d LEFT JOIN (SELECT doc_id, max(n) AS n FROM pieces GROUP BY 1) USING (doc_id)""")
def packet_parts(spark, folder):
    return _paragraphs(spark, folder).select("doc_id", packing.byte_parts(F.col("p")).alias("parts"))


SPANS = r"""
note_rows AS (
  SELECT d.doc_id, unnest(string_split(text, chr(10))) AS quoted_text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos, coalesce(toxic, 0) AS toxic
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
notes AS (SELECT doc_id, 'n' || pos AS annotation_id, quoted_text FROM note_rows WHERE toxic = 0)"""


def _form(x: str) -> str:
    single = r"'(^|[^\p{L}\p{N}_])[a-z]($|[^\p{L}\p{N}_])', '\1\2', 'g'"
    flat = rf"regexp_replace(regexp_replace({x}, '\p{{C}}', '', 'g'), '[\s\p{{Z}}]+', ' ', 'g')"
    return rf"lower(trim(regexp_replace(regexp_replace(regexp_replace({flat}, {single}), {single}), '[\s\p{{Z}}]+', ' ', 'g')))"


OVERLAP = with_ctes(CHUNK_FOLD, SPANS) + f""",
spans AS (SELECT doc_id, annotation_id, {_form('quoted_text')} AS span FROM notes),
long_enough AS (SELECT *, string_split(span, ' ') AS w FROM spans WHERE length(span) >= 10),
bodies AS (SELECT doc_id, n, {_form('text')} AS body FROM pieces)"""
MATCH = """(contains(b.body, s.span) OR (len(s.w) >= 4 AND len(list_filter(range(1, len(s.w) - least(len(s.w), 6) + 2),
  lambda i: contains(b.body, array_to_string(s.w[i:i + least(len(s.w), 6) - 1], ' ')))) > 0))"""


def _notes(spark, folder):
    labels = table(spark, folder, "labels").select("doc_id", "toxic")
    docs = table(spark, folder, "documents").select("doc_id", "text").join(labels, "doc_id", "left")
    quotes = docs.select("doc_id", "toxic", F.posexplode(lines(F.col("text"))).alias("pos", "quoted_text"))
    return quotes.select(
        F.col("doc_id").alias("material_id"), F.lit(1).alias("page"),
        F.concat(F.lit("n"), F.col("pos").cast("string")).alias("annotation_id"), "quoted_text",
        F.when(F.col("toxic") == 1, "note").otherwise("highlight").alias("type"))


def _overlaps(spark, folder):
    pieces = _chunks(spark, folder).select(F.col("doc_id").alias("material_id"), F.lit(1).alias("page"),
                                           F.format_string("chk_%05d", F.col("n") + 1).alias("chunk_id"), "text")
    return overlap.overlaps(pieces, _notes(spark, folder))


@query("chunk_annotation_overlap", "J25", OVERLAP + f"""
SELECT b.doc_id AS material_id, format('chk_{{:05d}}', b.n) AS chunk_id, s.annotation_id
FROM bodies b JOIN long_enough s ON s.doc_id = b.doc_id WHERE {MATCH}""")
def chunk_annotation_overlap(spark, folder):
    return _overlaps(spark, folder).select("material_id", "chunk_id", "annotation_id")


@query("chunk_emphasis", "J26", OVERLAP + f"""
SELECT b.doc_id AS material_id, format('chk_{{:05d}}', b.n) AS chunk_id,
  EXISTS (SELECT 1 FROM long_enough s WHERE s.doc_id = b.doc_id AND {MATCH}) AS emphasized FROM bodies b""")
def chunk_emphasis(spark, folder):
    hit = _overlaps(spark, folder).select("material_id", "chunk_id").distinct().withColumn("hit", F.lit(True))
    every = _chunks(spark, folder).select(F.col("doc_id").alias("material_id"), F.format_string("chk_%05d", F.col("n") + 1).alias("chunk_id"))
    return every.join(hit, ["material_id", "chunk_id"], "left").select(
        "material_id", "chunk_id", F.coalesce("hit", F.lit(False)).alias("emphasized"))


@query("annotation_page_membership", "J27", """
SELECT p_partkey AS chunk_id, l_orderkey AS annotation_id, l_linenumber AS page
FROM part JOIN lineitem ON l_partkey = p_partkey WHERE list_contains(range(1, least(p_size, 7) + 1), l_linenumber)""")
def annotation_page_membership(spark, folder):
    """Annotations standing on one of the pages a chunk was cut from."""
    pieces = table(spark, folder, "part").select(
        F.col("p_partkey").alias("chunk_id"), F.sequence(F.lit(1), F.least("p_size", F.lit(7))).alias("source_pages"))
    notes = table(spark, folder, "lineitem").select(
        F.col("l_partkey").alias("chunk_id"), F.col("l_orderkey").alias("annotation_id"), F.col("l_linenumber").alias("page"))
    return pieces.join(notes, "chunk_id").where(F.array_contains("source_pages", F.col("page"))).select("chunk_id", "annotation_id", "page")


@query("page_refs_attach", "J23", """
SELECT c.conv_id AS material_id, c.turn AS page, coalesce(r.turn, -1) AS annotation_page, coalesce('ann-' || r.conv_id || '-' || r.turn, '') AS annotation_id
FROM conversations c LEFT JOIN (SELECT * FROM conversations WHERE role = 'user') r ON r.conv_id = c.conv_id AND r.turn = c.turn""")
def page_refs_attach(spark, folder):
    pages = table(spark, folder, "conversations").select(F.col("conv_id").alias("material_id"), F.col("turn").alias("page"))
    refs = table(spark, folder, "conversations").where("role = 'user'").select(
        F.col("conv_id").alias("material_id"), F.col("turn").alias("page"), F.col("turn").alias("annotation_page"),
        F.concat_ws("-", F.lit("ann"), "conv_id", "turn").alias("annotation_id"))
    return pages.join(refs, ["material_id", "page"], "left").select(
        "material_id", "page", F.coalesce("annotation_page", F.lit(-1)).alias("annotation_page"), F.coalesce("annotation_id", F.lit("")).alias("annotation_id"))


@query("section_boundaries", "J24", """
WITH toc AS (SELECT page_id, regexp_extract(html, '<h1>([^<]*)', 1) AS t FROM pages WHERE contains(url, 'https'))
SELECT p.page_id, coalesce(nullif(toc.t, ''), regexp_extract(p.html, '<title>([^<]*)', 1)) AS section
FROM pages p LEFT JOIN toc ON toc.page_id = p.page_id""")
def section_boundaries(spark, folder):
    pages = table(spark, folder, "pages")
    toc = pages.where(F.contains("url", F.lit("https"))).select("page_id", F.regexp_extract("html", "<h1>([^<]*)", 1).alias("t"))
    return pages.join(toc, "page_id", "left").select(
        "page_id", F.coalesce(F.nullif("t", F.lit("")), F.regexp_extract("html", "<title>([^<]*)", 1)).alias("section"))
