"""Delta merges, claims, ids and bridge maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import lists as L
from lectern.functions import names as N
from lectern.operators import deltas as ops
from lectern.operators.tables import spread, stored
from lectern.plans import corpus
from lectern.plans.corpus import CLUSTERS, CONCEPTS, MEMBERSHIPS, table, with_ctes
from lectern.plans.registry import query

REFS = """
refs AS (
  SELECT c.material_id || '/' || c.pos AS ref_id, source AS cluster_id, CAST(substr(source, 4) AS BIGINT) AS cluster_pos,
         c.pos AS src_pos, c.material_id,
         CASE pos WHEN 0 THEN concept_name || 'S' WHEN 1 THEN left(concept_name, greatest(length(concept_name) - 1, 1))
                  WHEN 2 THEN concept_name || 'xyz' WHEN 3 THEN 'zz unknown' ELSE concept_name END AS concept_name
  FROM concepts c JOIN documents d ON d.doc_id = c.material_id),
keyed AS (
  SELECT *, CASE WHEN k LIKE '%ies' AND length(k) > 4 THEN left(k, length(k) - 3) || 'y'
    WHEN k LIKE '%es' AND length(k) > 3 THEN left(k, length(k) - 2) WHEN k LIKE '%s' AND length(k) > 2 THEN left(k, length(k) - 1) ELSE k END AS key
  FROM (SELECT *, trim(lower(concept_name)) AS k FROM refs)),
exact AS (SELECT r.ref_id, c.concept_key FROM keyed r JOIN concepts c ON c.material_id = r.material_id AND c.concept_key = r.key),
named AS (
  SELECT r.ref_id, min(c.concept_key) AS concept_key FROM keyed r JOIN concepts c ON c.material_id = r.material_id AND lower(trim(c.concept_name)) = r.k
  WHERE r.ref_id NOT IN (SELECT ref_id FROM exact) GROUP BY 1 HAVING count(*) = 1),
near AS (
  SELECT r.ref_id, min(c.concept_key) AS concept_key FROM keyed r JOIN concepts c ON c.material_id = r.material_id
    AND (starts_with(c.concept_key, r.key) OR starts_with(r.key, c.concept_key))
  WHERE r.ref_id NOT IN (SELECT ref_id FROM exact UNION ALL SELECT ref_id FROM named) GROUP BY 1 HAVING count(*) = 1),
resolved AS (SELECT * FROM exact UNION ALL SELECT * FROM named UNION ALL SELECT * FROM near)"""
CLAIMS = """,
claims AS (
  SELECT r.material_id, x.concept_key, arg_min(r.cluster_id, {'a': r.cluster_pos, 'b': r.src_pos}) AS cluster_id
  FROM resolved x JOIN refs r USING (ref_id) GROUP BY 1, 2),
kept AS (SELECT * FROM claims WHERE cluster_id IN (SELECT cluster_id FROM claims GROUP BY 1 HAVING count(DISTINCT material_id) >= 2))"""


def _refs(spark, folder, concepts):
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("material_id"), F.col("source").alias("cluster_id"))
    rows = concepts.join(docs, "material_id")
    name, pos = F.col("concept_name"), F.col("pos")
    shorter = F.substring(name, F.lit(1), F.greatest(F.length(name) - 1, F.lit(1)))
    proposed = (
        F.when(pos == 0, F.concat(name, F.lit("S"))).when(pos == 1, shorter)
        .when(pos == 2, F.concat(name, F.lit("xyz"))).when(pos == 3, "zz unknown").otherwise(name))
    return rows.select(
        F.concat_ws("/", "material_id", "pos").alias("ref_id"), "cluster_id",
        F.substring("cluster_id", 4, 10).cast("bigint").alias("cluster_pos"),
        pos.alias("src_pos"), "material_id", proposed.alias("concept_name"))


@query("reference_resolve", "J22", with_ctes(CONCEPTS, REFS) + "SELECT ref_id, concept_key FROM resolved")
def reference_resolve(spark, folder):
    concepts = _concepts(spark, folder)
    return ops.resolve_references(_refs(spark, folder, concepts), concepts)


def _concepts(spark, folder):
    """Written once: they are asked for as references, as what these are resolved by and as what the claims are graded by, and
    each time anew the texts would be read and cut into words."""
    return stored(corpus.concepts(spark, folder), "concepts")


def _claims(spark, folder, concepts):
    refs = _refs(spark, folder, concepts)
    resolved = ops.resolve_references(refs, concepts)
    return ops.first_claims(refs.join(resolved, "ref_id"))


@query("first_claim", "W13", with_ctes(CONCEPTS, REFS) + CLAIMS + "SELECT material_id, concept_key, cluster_id FROM claims")
def first_claim(spark, folder):
    return _claims(spark, folder, _concepts(spark, folder)).select("material_id", "concept_key", "cluster_id")


@query("validated_clusters", "G4", with_ctes(CONCEPTS, REFS) + CLAIMS + """
SELECT cluster_id, count(*) AS concepts, count(DISTINCT material_id) AS materials,
  round(greatest(0.0, least(1.0, avg(CASE relevance WHEN 'high' THEN 1.0 WHEN 'medium' THEN 0.7 ELSE 0.4 END))), 6) AS confidence
FROM kept JOIN concepts USING (material_id, concept_key) GROUP BY 1""")
def validated_clusters(spark, folder):
    concepts = _concepts(spark, folder)
    kept = ops.connected(_claims(spark, folder, concepts))
    graded = kept.join(concepts.select("material_id", "concept_key", "relevance"), ["material_id", "concept_key"])
    confidence = F.when(F.col("relevance") == "high", 1.0).when(F.col("relevance") == "medium", 0.7).otherwise(0.4)
    return graded.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("concepts"), F.count_distinct("material_id").alias("materials"),
        F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.avg(confidence))), 6).alias("confidence"))


@query("concept_index_first_wins", "H11 G4", """
SELECT l_orderkey AS material_id, l_linenumber AS concept_key, arg_min(l_partkey, l_suppkey * 1000000 + l_partkey) AS first_value,
       arg_max(l_partkey, l_suppkey * 1000000 + l_partkey) AS last_value FROM lineitem GROUP BY 1, 2""")
def concept_index_first_wins(spark, folder):
    """The validation index keeps the first duplicate, the audit index the last."""
    order = F.col("l_suppkey") * 1000000 + F.col("l_partkey")
    return table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("material_id"), F.col("l_linenumber").alias("concept_key")).agg(
        F.min_by("l_partkey", order).alias("first_value"), F.max_by("l_partkey", order).alias("last_value"))


@query("next_ids", "W11 G5", """
WITH o AS (SELECT o_orderkey, o_orderstatus AS scope, CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderkey END AS idx FROM orders),
m AS (SELECT scope, max(idx) AS top FROM o GROUP BY 1)
SELECT o_orderkey, scope || '__local_' || format('{:07d}', coalesce(idx, top + row_number() OVER (PARTITION BY scope, idx IS NULL ORDER BY o_orderkey))) AS cluster_id
FROM o JOIN m USING (scope)""")
def next_ids(spark, folder):
    """Rows with an id keep it; new rows continue after the scope's highest."""
    rows = table(spark, folder, "orders").select(
        "o_orderkey", F.col("o_orderstatus").alias("scope"),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_orderkey")).alias("idx"))
    top = rows.groupBy("scope").agg(F.coalesce(F.max("idx"), F.lit(0)).alias("top"))
    fresh = ops.running_number(rows.where("idx IS NULL"), ["scope"], "o_orderkey").join(top, "scope").select(
        "o_orderkey", "scope", (F.col("top") + F.col("number")).alias("idx"))
    known = rows.where("idx IS NOT NULL").select("o_orderkey", "scope", "idx")
    return known.unionByName(fresh).select(
        "o_orderkey", ops.cluster_id(F.col("scope"), F.col("idx")).alias("cluster_id"))


@query("slug_dedupe", "W12", """
WITH s AS (SELECT p_partkey, replace(p_name, ' ', '-') AS slug, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS n FROM part)
SELECT p_partkey, CASE WHEN n = 1 THEN slug ELSE slug || '-' || n END AS slug FROM s""")
def slug_dedupe(spark, folder):
    rows = table(spark, folder, "part").select("p_partkey", N.slugify(F.col("p_name")).alias("slug"))
    numbered = ops.running_number(rows, ["slug"], "p_partkey")
    return numbered.select("p_partkey", F.when(F.col("number") == 1, F.col("slug")).otherwise(
        F.concat("slug", F.lit("-"), F.col("number").cast("string"))).alias("slug"))


BRIDGE_MEMBERS = """
members AS (
  SELECT DISTINCT l_orderkey AS bridge_id, l_suppkey AS cluster_id FROM lineitem),
scoped AS (SELECT m.bridge_id, m.cluster_id, c.canonical_name, c.domain, c.collection, c.weight FROM members m JOIN clusters c ON c.cluster_id = m.cluster_id),
eligible AS (
  SELECT bridge_id, min(domain) AS domain, count(*) AS members, count(DISTINCT collection) >= 2 AS several_collections
  FROM scoped GROUP BY 1 HAVING count(DISTINCT domain) = 1 AND count(*) >= CASE WHEN count(DISTINCT collection) >= 2 THEN 2 ELSE 3 END)"""


def _members(spark, folder):
    pairs = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("bridge_id"), F.col("l_suppkey").alias("cluster_id")).distinct()
    return pairs.join(corpus.clusters(spark, folder).drop("bridge_id"), "cluster_id")


@query("bridge_eligibility", "U10", with_ctes(CLUSTERS, BRIDGE_MEMBERS) + "SELECT * FROM eligible")
def bridge_eligibility(spark, folder):
    return ops.eligible_bridges(_members(spark, folder))


@query("bridges_finalized", "G11 A10 O6", with_ctes(CLUSTERS, BRIDGE_MEMBERS) + """
SELECT s.bridge_id, e.domain, e.members, min(canonical_name) AS canonical_name, round_even(avg(weight), 4) AS confidence
FROM scoped s JOIN eligible e ON e.bridge_id = s.bridge_id GROUP BY 1, 2, 3 ORDER BY lower(min(canonical_name)), 1""")
def bridges_finalized(spark, folder):
    members = _members(spark, folder)
    facts = members.groupBy("bridge_id").agg(F.min("canonical_name").alias("canonical_name"), F.bround(F.avg("weight"), 4).alias("confidence"))
    return ops.eligible_bridges(members).join(facts, "bridge_id").select(
        "bridge_id", "domain", "members", "canonical_name", "confidence").orderBy(F.lower("canonical_name"), "bridge_id")


@query("bridge_aliases", "G11 U3", with_ctes(CLUSTERS, BRIDGE_MEMBERS) + """
SELECT bridge_id, canonical_name AS alias, n FROM (
  SELECT bridge_id, canonical_name, row_number() OVER (PARTITION BY bridge_id ORDER BY canonical_name) AS n FROM scoped WHERE bridge_id IN (SELECT bridge_id FROM eligible)) WHERE n <= 8""")
def bridge_aliases(spark, folder):
    from lectern.operators.evidence import sample_per

    members = _members(spark, folder)
    chosen = members.join(ops.eligible_bridges(members), "bridge_id", "left_semi")
    return sample_per(chosen, "bridge_id", 8, F.asc("canonical_name")).select("bridge_id", F.col("canonical_name").alias("alias"), F.col("rn").alias("n"))


@query("represented_pending", "G12", with_ctes(CLUSTERS, BRIDGE_MEMBERS) + """
SELECT s_suppkey AS cluster_id FROM supplier WHERE s_acctbal < 3000 AND s_suppkey IN (SELECT cluster_id FROM scoped SEMI JOIN eligible USING (bridge_id))""")
def represented_pending(spark, folder):
    members = _members(spark, folder)
    placed = members.join(ops.eligible_bridges(members), "bridge_id", "left_semi").select("cluster_id")
    pending = table(spark, folder, "supplier").where("s_acctbal < 3000").select(F.col("s_suppkey").alias("cluster_id"))
    return pending.join(placed, "cluster_id", "left_semi")


@query("bridge_pending_inputs", "G9 H7", """
WITH cur AS (SELECT s_suppkey AS cluster_id, substr(sha256(s_name || chr(31) || CAST(s_nationkey AS VARCHAR)), 1, 16) AS fp FROM supplier),
prev AS (SELECT s_suppkey AS cluster_id, substr(sha256(s_name || chr(31) || CASE WHEN s_acctbal > 8000 THEN 'old' ELSE CAST(s_nationkey AS VARCHAR) END), 1, 16) AS fp FROM supplier),
mem AS (SELECT DISTINCT l_suppkey AS cluster_id FROM lineitem WHERE l_shipdate < TIMESTAMP '1995-02-01')
SELECT cur.cluster_id FROM cur LEFT JOIN prev USING (cluster_id) WHERE prev.fp IS DISTINCT FROM cur.fp OR cur.cluster_id NOT IN (SELECT cluster_id FROM mem)""")
def bridge_pending_inputs(spark, folder):
    s, items = table(spark, folder, "supplier"), table(spark, folder, "lineitem")
    old = F.when(F.col("s_acctbal") > 8000, "old").otherwise(F.col("s_nationkey").cast("string"))
    rows = s.select(F.col("s_suppkey").alias("cluster_id"), L.canonical_hash(F.col("s_name"), F.col("s_nationkey")).alias("fp"),
                    L.canonical_hash(F.col("s_name"), old).alias("previous"))
    before = F.lit("1995-02-01").cast(dict(items.dtypes)["l_shipdate"])
    placed = items.where(F.col("l_shipdate") < before).select(F.col("l_suppkey").alias("cluster_id"), F.lit(True).alias("placed")).distinct()
    return rows.join(placed, "cluster_id", "left").where(~F.col("fp").eqNullSafe(F.col("previous")) | F.col("placed").isNull()).select("cluster_id")


REVIEWS = """
reviews AS (
  SELECT user_id AS cluster_id, arg_max(event_type, ts) AS status, max(ts) AS run_at, arg_max(event_id, ts) AS review_id FROM events GROUP BY 1)"""


def _reviews(spark, folder):
    rows = table(spark, folder, "events").select(F.col("user_id").alias("cluster_id"), F.col("event_type").alias("status"), "ts", F.col("event_id").alias("review_id"))
    return ops.latest_per(rows, "cluster_id", "ts", "review_id")


@query("latest_review", "W10", with_ctes(REVIEWS) + "SELECT cluster_id, status, review_id FROM reviews")
def latest_review(spark, folder):
    return _reviews(spark, folder).select("cluster_id", "status", "review_id")


@query("audit_targets", "G7 H35", with_ctes(REVIEWS) + """,
r AS (SELECT cluster_id, CASE WHEN status = 'view' THEN 'open' ELSE 'validated' END AS status, CASE WHEN status = 'error' THEN 'a' ELSE 'b' END AS fp FROM reviews),
c AS (SELECT c_custkey AS cluster_id, CASE WHEN c_acctbal > 5000 THEN 'a' ELSE 'b' END AS fp FROM customer)
SELECT c.cluster_id, CASE WHEN r.fp IS NULL THEN 'missing_review' WHEN r.status = 'open' THEN 'changed_since_last_audit,open_review' ELSE 'changed_since_last_audit' END AS reasons
FROM c LEFT JOIN r USING (cluster_id) WHERE r.fp IS NULL OR r.fp <> c.fp""")
def audit_targets(spark, folder):
    reviews = _reviews(spark, folder).select(
        "cluster_id", F.when(F.col("status") == "view", "open").otherwise("validated").alias("status"),
        F.when(F.col("status") == "error", "a").otherwise("b").alias("input_fingerprint"))
    rows = table(spark, folder, "customer").select(F.col("c_custkey").alias("cluster_id"), F.when(F.col("c_acctbal") > 5000, "a").otherwise("b").alias("fingerprint"))
    return ops.audit_targets(rows, reviews)


@query("review_coverage_backfill", "U9", with_ctes(REVIEWS) + """
SELECT cluster_id, status, 'reviewed' AS note FROM reviews
UNION ALL SELECT c_custkey, 'validated', 'Current bridge remains coherent in this audit pass.' FROM customer WHERE c_custkey NOT IN (SELECT cluster_id FROM reviews)""")
def review_coverage_backfill(spark, folder):
    reviews = _reviews(spark, folder).select("cluster_id", "status", F.lit("reviewed").alias("note"))
    rest = table(spark, folder, "customer").select(F.col("c_custkey").alias("cluster_id")).join(reviews, "cluster_id", "left_anti")
    return reviews.unionByName(rest.select("cluster_id", F.lit("validated").alias("status"), F.lit("Current bridge remains coherent in this audit pass.").alias("note")))


@query("review_merge", "G8 H38", with_ctes(REVIEWS) + """,
u AS (SELECT o_custkey AS cluster_id, max(o_orderpriority) AS status FROM orders GROUP BY 1)
SELECT coalesce(u.cluster_id, r.cluster_id) AS cluster_id, coalesce(u.status, r.status) AS status FROM reviews r FULL OUTER JOIN u ON u.cluster_id = r.cluster_id""")
def review_merge(spark, folder):
    updates = table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("cluster_id")).agg(F.max("o_orderpriority").alias("status"))
    return ops.keep_unless_given(_reviews(spark, folder), updates, "cluster_id", ["status"])


@query("reflection_merge", "G20 H30", """
SELECT d.doc_id, coalesce(CASE WHEN l.toxic = 1 THEN NULL ELSE 'quality ' || l.quality END, d.source) AS why, coalesce(CAST(l.quality AS VARCHAR), d.lang) AS takeaways
FROM documents d LEFT JOIN labels l USING (doc_id)""")
def reflection_merge(spark, folder):
    old = table(spark, folder, "documents").select("doc_id", F.col("source").alias("why"), F.col("lang").alias("takeaways"))
    new = table(spark, folder, "labels").select(
        "doc_id", F.when(F.col("toxic") != 1, F.concat(F.lit("quality "), F.col("quality").cast("string"))).alias("why"),
        F.col("quality").cast("string").alias("takeaways"))
    return ops.keep_unless_given(old, new, "doc_id", ["why", "takeaways"])


@query("cluster_delta_applied", "G3 H5", with_ctes(MEMBERSHIPS) + """,
links AS (SELECT DISTINCT o_custkey AS cluster_id, o_orderkey AS material_id FROM orders),
fresh AS (SELECT DISTINCT 1000000 + c_nationkey AS cluster_id, c_custkey AS material_id FROM customer)
SELECT * FROM memberships UNION SELECT * FROM links WHERE cluster_id IN (SELECT cluster_id FROM memberships) UNION SELECT * FROM fresh""")
def cluster_delta_applied(spark, folder):
    """Links to unknown clusters are skipped, new clusters appended, repeats dropped."""
    # repeats are dropped once, at the end; ids are few, so each is kept once for the join
    existing = table(spark, folder, "lineitem").select(F.col("l_suppkey").alias("cluster_id"), F.col("l_partkey").alias("material_id"))
    ids = existing.select("cluster_id").distinct()
    links = table(spark, folder, "orders").select(F.col("o_custkey").alias("cluster_id"), F.col("o_orderkey").alias("material_id")).join(ids, "cluster_id", "left_semi")
    fresh = table(spark, folder, "customer").select((F.lit(1000000) + F.col("c_nationkey")).cast("bigint").alias("cluster_id"), F.col("c_custkey").alias("material_id"))
    total = existing.count() + table(spark, folder, "orders").count()
    return spread(existing.unionByName(links).unionByName(fresh), total, "cluster_id", "material_id").distinct()


@query("response_validation", "G10", """
SELECT o_orderkey, s_suppkey IS NOT NULL AS accepted, CASE WHEN s_suppkey IS NULL THEN 'unknown local cluster ' || o_custkey ELSE '' END AS error
FROM orders LEFT JOIN supplier ON s_suppkey = o_custkey""")
def response_validation(spark, folder):
    known = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("o_custkey"), F.lit(True).alias("known"))
    joined = table(spark, folder, "orders").select("o_orderkey", "o_custkey").join(known, "o_custkey", "left")
    return joined.select("o_orderkey", F.col("known").isNotNull().alias("accepted"), F.when(
        F.col("known").isNull(), F.concat(F.lit("unknown local cluster "), F.col("o_custkey").cast("string"))).otherwise("").alias("error"))


@query("audit_update_applied", "G6 H19", with_ctes(MEMBERSHIPS) + """,
gone AS (SELECT p_partkey AS material_id FROM part WHERE p_size < 10),
added AS (SELECT DISTINCT l_suppkey AS cluster_id, l_orderkey + 10000000 AS material_id FROM lineitem WHERE l_returnflag = 'A'),
final AS (SELECT * FROM memberships WHERE material_id NOT IN (SELECT material_id FROM gone) UNION SELECT * FROM added)
SELECT cluster_id, count(*) AS materials FROM final GROUP BY 1 HAVING count(*) >= 2""")
def audit_update_applied(spark, folder):
    gone = table(spark, folder, "part").where("p_size < 10").select(F.col("p_partkey").alias("material_id"))
    kept = corpus.memberships(spark, folder).join(gone, "material_id", "left_anti").select("cluster_id", "material_id")
    added = table(spark, folder, "lineitem").where("l_returnflag = 'A'").select(
        F.col("l_suppkey").alias("cluster_id"), (F.col("l_orderkey") + 10000000).alias("material_id"))
    final = kept.unionByName(added).distinct()
    return final.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("materials")).where("materials >= 2")


@query("findings_merge", "G19", """
SELECT event_id, 'graph:' || event_id AS finding_id, event_type AS finding_type FROM events WHERE event_type <> 'view'
UNION ALL SELECT event_id, 'kept:' || event_id, event_type FROM events WHERE event_type = 'view'""")
def findings_merge(spark, folder):
    """Findings without an id get one; a null proposal keeps the stored rows."""
    rows = table(spark, folder, "events").select("event_id", F.col("event_type").alias("finding_type"), F.when(
        F.col("event_type") == "view", F.concat(F.lit("kept:"), F.col("event_id").cast("string"))).alias("given"))
    made = F.concat(F.lit("graph:"), F.col("event_id").cast("string"))
    return rows.select("event_id", L.first_text(F.col("given"), made).alias("finding_id"), "finding_type")


@query("alias_dedupe", "U3", """
SELECT p_partkey, p_name || '|' || upper(p_brand) || '|' || p_type AS aliases FROM part""")
def alias_dedupe(spark, folder):
    raw = F.array("p_name", F.concat(F.lit(" "), F.upper("p_name"), F.lit(" ")), F.upper("p_brand"), F.lit(""), "p_brand", "p_type", F.lower("p_type"))
    return table(spark, folder, "part").select("p_partkey", F.array_join(L.dedupe_folded(raw), "|").alias("aliases"))


@query("horizon_overlaps", "U6", """
SELECT p_partkey, CASE WHEN lower(split_part(p_name, ' ', 1)) = lower(p_type) THEN 'objectives/progress' ELSE '' END AS clashes FROM part""")
def horizon_overlaps(spark, folder):
    words = F.split("p_name", " ")
    first = F.array(F.concat(F.lit(" "), F.get(words, F.lit(0))))
    return table(spark, folder, "part").select("p_partkey", F.array_join(L.disjoint_violations(
        ("objectives", first), ("progress", F.array("p_type")), ("focus", F.array("p_brand"))), ",").alias("clashes"))


@query("reflection_due", "G21", """
WITH c AS (SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS u, max(ts) AS t,
  count(*) FILTER (ts <= TIMESTAMP '2024-01-25 00:00:00') AS n0, count(DISTINCT user_id) FILTER (ts <= TIMESTAMP '2024-01-25 00:00:00') AS u0 FROM events GROUP BY 1)
SELECT event_type, CASE WHEN abs(n - n0) >= 5 OR abs(u - u0) >= 3 THEN 'enough graph change accumulated'
  WHEN epoch(TIMESTAMP '2024-02-20 00:00:00' - t) / 3600 >= 168 THEN 'graph reflection periodic interval reached' ELSE 'graph reflection deferred by schedule' END AS reason FROM c""")
def reflection_due(spark, folder):
    rows = table(spark, folder, "events")
    now = F.lit("2024-02-20 00:00:00").cast(dict(rows.dtypes)["ts"])
    # the stamp: what the last reflection had counted
    old = F.col("ts") <= F.lit("2024-01-25 00:00:00").cast(dict(rows.dtypes)["ts"])
    counts = rows.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("u"), F.max("ts").alias("t"),
        F.count_if(old).alias("n0"), F.count_distinct(F.when(old, F.col("user_id"))).alias("u0"))
    hours = F.timestamp_diff("SECOND", F.col("t"), now) / 3600
    return counts.select("event_type", F.when((F.abs(F.col("n") - F.col("n0")) >= 5) | (F.abs(F.col("u") - F.col("u0")) >= 3), "enough graph change accumulated")
                         .when(hours >= 168, "graph reflection periodic interval reached").otherwise("graph reflection deferred by schedule").alias("reason"))


@query("new_project_evidence", "G22 H20", """
WITH cur AS (SELECT user_id, event_id, sha256(props) AS fp FROM events),
prev AS (SELECT user_id, event_id, sha256(CASE WHEN value > 90 THEN 'edited' ELSE props END) AS fp FROM events WHERE event_type <> 'error')
SELECT c.user_id, CAST(count_if(p.fp IS NULL OR p.fp <> c.fp) AS BIGINT) AS changed FROM cur c LEFT JOIN prev p USING (event_id) GROUP BY 1""")
def new_project_evidence(spark, folder):
    rows = table(spark, folder, "events")
    cur = rows.select("user_id", "event_id", F.sha2("props", 256).alias("fp"))
    prev = rows.where("event_type != 'error'").select("event_id", F.sha2(F.when(F.col("value") > 90, "edited").otherwise(F.col("props")), 256).alias("old"))
    return cur.join(prev, "event_id", "left").groupBy("user_id").agg(F.count_if(~F.col("fp").eqNullSafe(F.col("old"))).alias("changed"))
