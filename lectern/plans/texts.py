"""Text and name functions applied to whole columns of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import lists as L
from lectern.functions import names as N
from lectern.functions import text as T
from lectern.functions.fixed import DOCUMENT_TYPE_SIGNALS, STOP_WORDS
from lectern.operators import doctypes
from lectern.plans.corpus import table
from lectern.plans.registry import query

TIDY = r"""trim(regexp_replace(regexp_replace(translate({x}, '‐‑‒–—', '-----'), '[ \t]+', ' ', 'g'), '[\s\p{{Z}}]+([,.;:!?])', '\1', 'g'))"""


def _tidy(x: str) -> str:
    return TIDY.format(x=x)


def _docs(spark, folder):
    return table(spark, folder, "documents").select("doc_id", "text")


KEY_SQL = """
CASE WHEN length(last) <= 3 THEN head || last
     WHEN last LIKE '%ies' AND length(last) > 4 THEN head || left(last, length(last) - 3) || 'y'
     WHEN regexp_matches(last, '(ses|xes|zes|ches|shes)$') THEN head || left(last, length(last) - 2)
     WHEN last LIKE '%s' AND NOT regexp_matches(last, '(ss|us|is)$') THEN head || left(last, length(last) - 1)
     ELSE head || last END"""


@query("concept_key_norm", "X4", r"""
WITH k AS (SELECT doc_id, trim(regexp_replace(lower(string_split(text, chr(10))[1]), '[\s\p{Z}]+', ' ', 'g')) AS k FROM documents),
p AS (SELECT doc_id, regexp_extract(k, '([^ ]*)$', 1) AS last, left(k, length(k) - length(regexp_extract(k, '([^ ]*)$', 1))) AS head FROM k)
SELECT doc_id, """ + KEY_SQL + " AS concept_key FROM p")
def concept_key_norm(spark, folder):
    return table(spark, folder, "documents").select("doc_id", T.bind(T.first_line(F.col("text")), N.concept_key).alias("concept_key"))


@query("concept_name_norm", "X5", r"""
WITH w AS (SELECT DISTINCT unnest(string_split(p_name || ' ' || lower(p_type) || 's', ' ')) AS name FROM part),
k AS (SELECT name, trim(lower(name)) AS k FROM w)
SELECT name, CASE WHEN k LIKE '%ies' AND length(k) > 4 THEN left(k, length(k) - 3) || 'y'
  WHEN k LIKE '%es' AND length(k) > 3 THEN left(k, length(k) - 2)
  WHEN k LIKE '%s' AND length(k) > 2 THEN left(k, length(k) - 1) ELSE k END AS concept_key FROM k""")
def concept_name_norm(spark, folder):
    words = F.split(F.concat("p_name", F.lit(" "), F.lower("p_type"), F.lit("s")), " ")
    names = table(spark, folder, "part").select(F.explode(words).alias("name")).distinct()
    return names.select("name", N.cluster_name_key(F.col("name")).alias("concept_key"))


@query("slugify", "X6", r"""
SELECT doc_id, trim(regexp_replace(regexp_replace(replace(trim(lower(string_split(text, chr(10))[1])), ' ', '-'), '[^a-z0-9-]+', '', 'g'), '-{2,}', '-', 'g'), '-') AS slug
FROM documents""")
def slugify(spark, folder):
    return table(spark, folder, "documents").select("doc_id", N.slugify(T.first_line(F.col("text"))).alias("slug"))


@query("match_score", "X7", r"""
WITH r AS (SELECT p_partkey, list_distinct(regexp_extract_all(lower(p_name), '[a-z0-9]+')) AS w,
  [p_type || ' widget', lower(p_brand) || ' red bolt', 'small'] AS refs FROM part),
s AS (SELECT p_partkey, list_transform(refs, lambda x: {'o': len(list_intersect(w, list_distinct(regexp_extract_all(lower(x), '[a-z0-9]+')))), 'c': length(x)}) AS s FROM r)
SELECT p_partkey, CAST(list_max(s)['o'] AS BIGINT) AS overlap, CAST(list_max(s)['c'] AS BIGINT) AS chars FROM s""")
def match_score(spark, folder):
    refs = F.array(F.concat("p_type", F.lit(" widget")), F.concat(F.lower("p_brand"), F.lit(" red bolt")), F.lit("small"))
    scored = table(spark, folder, "part").select("p_partkey", T.bind(refs, lambda r: N.match_score(F.col("p_name"), r)).alias("s"))
    return scored.select("p_partkey", F.col("s.overlap").cast("bigint").alias("overlap"), F.col("s.chars").cast("bigint").alias("chars"))


@query("line_normalize", "X8", "SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x: " + _tidy("x") + "), chr(10)) AS text FROM documents")
def line_normalize(spark, folder):
    docs = _docs(spark, folder).select("doc_id", T.compatibility_form(F.col("text")).alias("text"))
    return docs.select("doc_id", F.array_join(F.transform(T.lines(F.col("text")), T.tidy_line), "\n").alias("text"))


@query("sentence_stops", "X10", r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT doc_id, CAST(count_if(rtrim(line) LIKE '%.') AS BIGINT) AS stops, CAST(count_if(regexp_matches(line, '^\s*[0-9]+\s*$')) AS BIGINT) AS page_numbers, count(*) AS line_count
FROM l GROUP BY 1""")
def sentence_stops(spark, folder):
    def count(values, test):
        return F.size(F.filter(values, test)).cast("bigint")

    return table(spark, folder, "documents").select("doc_id", F.inline(F.transform(F.array(T.lines(F.col("text"))), lambda a: F.struct(
        count(a, T.ends_sentence).alias("stops"), count(a, T.is_page_number).alias("page_numbers"), F.size(a).cast("bigint").alias("line_count")))))


PARAS = r"""
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
t AS (SELECT doc_id, i, """ + _tidy("raw") + r""" AS line FROM l),
k AS (SELECT * FROM t WHERE line <> '' AND NOT regexp_matches(line, '^\s*[0-9]+\s*$')),
b AS (SELECT k.*, lag(line) OVER (PARTITION BY doc_id ORDER BY i) AS prev FROM k),
g AS (SELECT *, sum(CASE WHEN prev IS NULL OR rtrim(prev) LIKE '%.' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS grp FROM b),
paras AS (SELECT doc_id, grp, string_agg(line, ' ' ORDER BY i) AS para FROM g GROUP BY 1, 2)"""


@query("reflow_documents", "X9 X11 W17", "WITH " + PARAS + """,
joined AS (SELECT doc_id, string_agg(para, chr(10) || chr(10) ORDER BY grp) AS text FROM paras GROUP BY 1)
SELECT d.doc_id, coalesce(j.text, '') AS text FROM documents d LEFT JOIN joined j USING (doc_id)""")
def reflow_documents(spark, folder):
    docs = _docs(spark, folder).select("doc_id", T.compatibility_form(F.col("text")).alias("text"))
    return docs.select("doc_id", T.reflow(F.transform(T.lines(F.col("text")), T.tidy_line)).alias("text"))


_SINGLE = r"'(^|[^\p{L}\p{N}_])[a-z]($|[^\p{L}\p{N}_])', '\1\2', 'g'"


@query("matching_form", "X12", r"""
WITH c AS (SELECT doc_id, regexp_replace(regexp_replace(text, '\p{C}', '', 'g'), '[\s\p{Z}]+', ' ', 'g') AS t FROM documents),
s AS (SELECT doc_id, regexp_replace(regexp_replace(t, """ + _SINGLE + "), " + _SINGLE + r""") AS t FROM c)
SELECT doc_id, lower(trim(regexp_replace(t, '[\s\p{Z}]+', ' ', 'g'))) AS text FROM s""")
def matching_form(spark, folder):
    return _docs(spark, folder).select("doc_id", T.matching_form(F.col("text")).alias("text"))


@query("paragraphs", "X13 S10", "WITH " + PARAS + """
SELECT doc_id, CAST(grp AS BIGINT) AS n, para FROM paras""")
def paragraphs(spark, folder):
    docs = _docs(spark, folder).select("doc_id", T.reflow(F.transform(T.lines(F.col("text")), T.tidy_line)).alias("text"))
    return docs.select("doc_id", F.posexplode(T.paragraphs(F.col("text"))).alias("n", "para")).select(
        "doc_id", (F.col("n") + 1).cast("bigint").alias("n"), "para")


@query("keyword_tokens", "X14", r"""
SELECT doc_id, array_to_string(list_filter(regexp_extract_all(lower(replace(text, chr(173), '')), '[a-zA-ZÀ-ÿ]{3,}'), lambda w: w NOT IN ({stops})), ' ') AS tokens
FROM documents""".replace("{stops}", ", ".join(f"'{w}'" for w in STOP_WORDS)))
def keyword_tokens(spark, folder):
    return _docs(spark, folder).select("doc_id", F.array_join(T.keyword_tokens(F.col("text")), " ").alias("tokens"))


def _doc_type_sql(key: str, source: str) -> str:
    rows = []
    for order, (kind, text_signals, name_signals) in enumerate(DOCUMENT_TYPE_SIGNALS):
        rows += [f"('{kind}', {order}, '{s}', 1, 't')" for s in text_signals]
        rows += [f"('{kind}', {order}, '{s}', 2, 'n')" for s in name_signals]
    return f"""
WITH signals(kind, ord, signal, points, field) AS (VALUES {', '.join(rows)}),
d AS ({source}),
s AS (SELECT {key}, kind, ord, sum(points) AS score FROM d JOIN signals ON contains(CASE field WHEN 't' THEN body ELSE name END, signal) GROUP BY 1, 2, 3),
b AS (SELECT {key}, kind, score FROM s QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY score DESC, ord) = 1)
SELECT d.{key}, CASE WHEN b.score >= 3 THEN b.kind ELSE 'unknown' END AS document_type FROM d LEFT JOIN b USING ({key})"""


@query("doc_type_score", "X16", _doc_type_sql("p_partkey", """
SELECT p_partkey, lower(p_type || ' class chapter ' || p_name || ' load testing preface index lecture ' || p_brand) AS body, lower(p_name) AS name FROM part"""))
def doc_type_score(spark, folder):
    body = F.concat("p_type", F.lit(" class chapter "), "p_name", F.lit(" load testing preface index lecture "), "p_brand")
    return table(spark, folder, "part").select("p_partkey", doctypes.document_type(body, F.col("p_name")).alias("document_type"))


@query("doc_type_of_documents", "X16", _doc_type_sql("doc_id", "SELECT doc_id, lower(text) AS body, '' AS name FROM documents"))
def doc_type_of_documents(spark, folder):
    return _docs(spark, folder).select("doc_id", doctypes.document_type(F.col("text"), F.lit("")).alias("document_type"))


QUALITY = r"""
WITH b AS (SELECT doc_id, trim(text, e' \t\n\r') AS b FROM documents),
m AS (SELECT doc_id, b, length(regexp_replace(b, '[\s\p{Z}]+', '', 'g')) AS visible, len(regexp_extract_all(b, '[^\s\p{Z}]+')) AS tokens,
  len(list_filter(regexp_extract_all(b, '[^\s\p{Z}]+'), lambda t: regexp_matches(t, '\p{L}'))) AS alpha,
  len(regexp_extract_all(b, '[A-Za-zÀ-ÿ][A-Za-zÀ-ÿ''’\-]+')) AS normal,
  len(regexp_extract_all(b, '[\x{300}-\x{36F}\x{370}-\x{3FF}\x{180}-\x{2AF}]')) AS odd FROM b)
SELECT doc_id, round(CASE WHEN visible = 0 THEN 0.0 ELSE normal / greatest(alpha, 1) * 0.6 + alpha / greatest(tokens, 1) * 0.25 + (1 - odd / greatest(visible, 1)) * 0.15 END, 6) AS quality"""


@query("text_quality", "X17", QUALITY + " FROM m")
def text_quality(spark, folder):
    return _docs(spark, folder).select("doc_id", F.round(T.quality(F.col("text")), 6).alias("quality"))


@query("ocr_decision", "X18", QUALITY + """, CASE WHEN b = '' THEN true WHEN length(b) < 40 THEN false
  ELSE normal / greatest(alpha, 1) * 0.6 + alpha / greatest(tokens, 1) * 0.25 + (1 - odd / greatest(visible, 1)) * 0.15 < 0.45 OR odd / greatest(visible, 1) > 0.12 END AS needs_ocr FROM m""")
def ocr_decision(spark, folder):
    return _docs(spark, folder).select(
        "doc_id", F.round(T.quality(F.col("text")), 6).alias("quality"), T.needs_ocr(F.col("text")).alias("needs_ocr"))


@query("quote_clean", "X19", r"""
WITH p AS (SELECT page_id, list_filter(list_transform(regexp_extract_all(html, '>([^<]*)<', 1), lambda x: trim(regexp_replace(x, '[\r\n]', ' ', 'g'))), lambda x: x <> '') AS p FROM pages),
q AS (SELECT page_id, list_filter(list_transform(range(1, len(p) + 1), lambda i: CASE WHEN length(p[i]) <= 2 THEN NULL
    WHEN i > 1 AND regexp_matches(coalesce(p[i - 1], ''), '^\p{Lu}$') AND regexp_matches(p[i], '^\p{Ll}') THEN p[i - 1] || p[i] ELSE p[i] END), lambda x: x IS NOT NULL) AS q FROM p)
SELECT page_id, trim(regexp_replace(array_to_string(q, ' '), ' {2,}', ' ', 'g')) AS quote FROM q""")
def quote_clean(spark, folder):
    parts = F.array_join(F.transform(F.regexp_extract_all("html", F.lit(">([^<]*)<"), F.lit(1)), lambda x: F.regexp_replace(x, "[\r\n]", " ")), "\n")
    return table(spark, folder, "pages").select("page_id", T.clean_quote(parts).alias("quote"))


@query("author_split", "X21", r"""
SELECT o_orderkey, array_to_string(list_filter(list_transform(regexp_split_to_array(o_orderpriority || ', ' || o_orderstatus || ' and clerk; desk & line', '[,;&]| and '), lambda x: trim(x)), lambda x: x <> ''), '|') AS authors FROM orders""")
def author_split(spark, folder):
    raw = F.concat("o_orderpriority", F.lit(", "), "o_orderstatus", F.lit(" and clerk; desk & line"))
    return table(spark, folder, "orders").select("o_orderkey", F.array_join(T.authors(raw), "|").alias("authors"))


@query("date_year", "X20", """
SELECT o_orderkey, strftime(o_orderdate, '%Y') AS year FROM orders""")
def date_year(spark, folder):
    stamp = F.concat(F.lit("D:"), F.date_format("o_orderdate", "yyyyMMddHHmmss"))
    return table(spark, folder, "orders").select("o_orderkey", T.date_year(stamp).alias("year"))


@query("truncated_text", "X25", r"""
WITH t AS (SELECT doc_id, trim(text, e' \t\n\r') AS b FROM documents),
w AS (SELECT doc_id, b, string_split(trim(regexp_replace(b, '[\s\p{Z}]+', ' ', 'g')), ' ') AS w FROM t)
SELECT doc_id, CASE WHEN length(b) <= 220 THEN b ELSE rtrim(left(b, 219)) || '…' END AS short,
  CASE WHEN len(w) <= 42 THEN array_to_string(w, ' ') ELSE rtrim(array_to_string(w[1:42], ' '), '.,;: ') || '...' END AS words FROM w""")
def truncated_text(spark, folder):
    return table(spark, folder, "documents").select("doc_id", T.truncate(F.col("text")).alias("short"), T.bind(F.col("text"), T.truncate_words).alias("words"))


@query("pages_labels", "X27", """
WITH p AS (SELECT l_orderkey, list_sort(list_distinct(list(l_linenumber))) AS p FROM lineitem GROUP BY 1)
SELECT l_orderkey, CASE WHEN len(p) = 1 THEN 'p. ' ELSE 'pp. ' END || array_to_string(p, ', ') AS label FROM p""")
def pages_labels(spark, folder):
    # Line numbers run 1..7, so the set per order is bounded.
    pages = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_set("l_linenumber")).alias("p"))
    return pages.select("l_orderkey", T.pages_label(F.col("p")).alias("label"))


@query("timestamps_parsed", "X28", """
SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS seconds, false AS unreadable FROM events""")
def timestamps_parsed(spark, folder):
    iso = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    return table(spark, folder, "events").select(
        "event_id", F.unix_timestamp(T.iso_timestamp(iso)).alias("seconds"), T.iso_timestamp(F.col("props")).isNotNull().alias("unreadable"))


@query("token_estimate", "X29", "SELECT doc_id, length(text) // 4 AS tokens FROM documents")
def token_estimate(spark, folder):
    return table(spark, folder, "documents").select("doc_id", T.estimated_tokens(F.col("text")).alias("tokens"))


@query("annotation_injection", "X30", r"""
WITH d AS (SELECT doc_id, text, string_split(text, ' ')[1] AS q1, string_split(text, ' ')[2] AS q2 FROM documents),
s AS (SELECT doc_id, CASE WHEN coalesce(q1, '') <> '' THEN '[HIGHLIGHTED]' || q1 || '[/HIGHLIGHTED] [NOTE: first]' || substr(text, length(q1) + 1) ELSE text END AS t, q2 FROM d)
SELECT doc_id, CASE WHEN coalesce(q2, '') <> '' AND strpos(t, q2) > 0
  THEN left(t, strpos(t, q2) - 1) || '[HIGHLIGHTED]' || q2 || '[/HIGHLIGHTED]' || substr(t, strpos(t, q2) + length(q2)) ELSE t END AS text FROM s""")
def annotation_injection(spark, folder):
    words = F.split("text", " ")
    quotes = F.array(
        F.struct(F.get(words, F.lit(0)).alias("quoted_text"), F.lit("first").alias("comment"), F.lit(1).alias("page")),
        F.struct(F.get(words, F.lit(1)).alias("quoted_text"), F.lit("").alias("comment"), F.lit(1).alias("page")),
        F.struct(F.get(words, F.lit(2)).alias("quoted_text"), F.lit("").alias("comment"), F.lit(2).alias("page")))
    return table(spark, folder, "documents").select(
        "doc_id", T.inject_annotations(F.col("text"), quotes, F.lit(1)).alias("text"))


@query("toc_formatting", "X31", r"""
WITH h AS (SELECT page_id, regexp_extract_all(html, '<h([12])>([^<]*)', 1) AS l, regexp_extract_all(html, '<h([12])>([^<]*)', 2) AS t FROM pages),
e AS (SELECT page_id, list_filter(list_transform(range(1, len(t) + 1), lambda i: CASE WHEN t[i] = '' THEN NULL ELSE repeat('  ', CAST(l[i] AS INTEGER) - 1) || t[i] || ' (p. ' || i || ')' END), lambda x: x IS NOT NULL) AS e FROM h)
SELECT page_id, CASE WHEN len(e) = 0 THEN 'Not available' ELSE array_to_string(e, chr(10)) END AS toc FROM e""")
def toc_formatting(spark, folder):
    level = F.regexp_extract_all("html", F.lit("<h([12])>([^<]*)"), F.lit(1))
    title = F.regexp_extract_all("html", F.lit("<h([12])>([^<]*)"), F.lit(2))
    entries = F.transform(F.arrays_zip(level.alias("l"), title.alias("t")), lambda e, i: F.struct(
        e["t"].alias("title"), (i + 1).alias("page"), (e["l"].cast("int") - 1).alias("level")))
    return table(spark, folder, "pages").select("page_id", T.bind(entries, T.toc_text).alias("toc"))


@query("caption_candidates", "X33", """
SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: contains(lower(x), 'fig')), '|') AS captions FROM documents""")
def caption_candidates(spark, folder):
    return table(spark, folder, "documents").select("doc_id", F.array_join(T.caption_lines(F.col("text")), "|").alias("captions"))


@query("marked_sections", "X40", r"""
SELECT page_id, trim(regexp_extract(html, '(?s)<article>(.*?)</article>', 1)) AS section FROM pages""")
def marked_sections(spark, folder):
    page = F.replace(F.replace("html", F.lit("<article>"), F.lit("<!-- phase6:body:start -->")), F.lit("</article>"), F.lit("<!-- phase6:body:end -->"))
    return table(spark, folder, "pages").select("page_id", T.marked_section(page, "body").alias("section"))


@query("identity_hash", "X41", "SELECT doc_id, substr(sha256(text), 1, 12) AS material_id, sha256(text) AS file_hash FROM documents")
def identity_hash(spark, folder):
    return table(spark, folder, "documents").select("doc_id", L.material_id(F.col("text")).alias("material_id"), L.content_hash(F.col("text")).alias("file_hash"))


@query("doc_context_canonical", "X43", """
SELECT p_partkey, CASE WHEN trim(p_type) = '' OR lower(trim(p_type)) IN ('economy', 'unknown') THEN 'unknown' ELSE trim(p_type) END AS raw_document_type FROM part""")
def doc_context_canonical(spark, folder):
    raw = F.when(F.col("p_type") == "ECONOMY", "Unknown ").otherwise(F.col("p_type"))
    return table(spark, folder, "part").select("p_partkey", doctypes.canonical_type(raw).alias("raw_document_type"))


@query("markdown_tables", "X46", r"""
SELECT p_partkey, '| field | value | note |' || chr(10) || '| --- | --- | --- |' || chr(10) || '| name\|title | ' || p_name || ' |  |' || chr(10) ||
  '| brand | ' || p_brand || ' | ' || p_type || ' |' AS md FROM part""")
def markdown_tables(spark, folder):
    """Short rows are padded, pipes escaped, line breaks flattened."""
    header = F.array(F.lit("field"), F.lit("value"), F.lit("note"))
    rows = F.array(
        F.array(F.lit("name|title"), F.col("p_name")),
        F.array(F.lit("brand"), F.concat("p_brand", F.lit("\n")), F.col("p_type")))
    return table(spark, folder, "part").select("p_partkey", T.table_markdown(header, rows).alias("md"))


@query("fenced_text", "X47 H25", """
SELECT doc_id, '```' || chr(10) || text || chr(10) || '```' || chr(10) AS md FROM documents""")
def fenced_text(spark, folder):
    return table(spark, folder, "documents").select("doc_id", T.fenced(F.col("text")).alias("md"))
