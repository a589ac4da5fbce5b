"""Cluster audits: which proposals stand when each claim can be held once, and merging reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.fixed import REVIEW_BACKFILL, REVIEW_SEVERITIES, REVIEW_STATUSES, REVIEW_STATUS_NAMES
from lectern.operators.tables import stored

PAIR = ["scope", "material_id", "concept_key"]
NEED = 2  # materials


def accepted(claims: DataFrame, need: int = NEED) -> tuple[DataFrame, DataFrame]:
    """claims: scope, proposal, material_id, concept_key, retained -> decisions (scope, proposal, accepted) and held claims.

    Proposals of a scope are decided in the order of their numbers. A claim is held by the first accepted proposal that
    names it; retained ones (what a changed cluster keeps) are not contested. A proposal is accepted if what it holds is
    of `need` materials or more; a refused one gives its claims back. A round decides every proposal whose outcome can't
    depend on undecided ones any more: by the claims that no undecided proposal names before it, or by all it could get.
    The first undecided one is always decided, and rounds work on undecided proposals only. What is known of a pair are
    two numbers, the first accepted and the first undecided proposal that name it, so a pair named by many is no problem.
    """
    claims = stored(claims.select(*PAIR, "proposal", "retained").distinct(), "claims")
    own = ["scope", "proposal"]
    open_ = claims
    won = claims.select(*PAIR, F.col("proposal").alias("won")).limit(0)
    decided: DataFrame | None = None
    while True:
        contested = open_.where("not retained")
        first = contested.groupBy(*PAIR).agg(F.min("proposal").alias("first"))
        seen = contested.join(first, PAIR).join(won, PAIR, "left").where("won is null or won > proposal").select(
            *own, "material_id", (F.col("first") == F.col("proposal")).alias("sure"))
        seen = seen.union(open_.where("retained").select(*own, "material_id", F.lit(True)))
        materials = seen.groupBy(*own, "material_id").agg(F.max("sure").alias("sure"))
        counts = materials.groupBy(*own).agg(F.count("*").alias("possible"), F.count_if("sure").alias("sure"))
        judged = open_.select(*own).distinct().join(counts, own, "left").select(*own, F.when(
            F.col("sure") >= need, True).when(F.coalesce("possible", F.lit(0)) < need, False).alias("accepted"))
        judged = stored(judged, "judged")
        settled = judged.where("accepted is not null")
        decided = settled if decided is None else decided.union(settled)
        left = judged.where("accepted is null").select(*own)
        gained = open_.where("not retained").join(judged.where("accepted"), own, "left_semi").select(*PAIR, F.col("proposal").alias("won"))
        won = stored(won.union(gained).groupBy(*PAIR).agg(F.min("won").alias("won")), "won")
        if left.isEmpty():
            break
        open_ = stored(open_.join(left, own, "left_semi"), "open")
    chosen = claims.join(decided.where("accepted"), own, "left_semi")
    held = chosen.join(won, PAIR, "left").where("retained or won = proposal").select(*own, "material_id", "concept_key", "retained")
    return decided, held


def _status(name: str) -> Column:
    given = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    for old, new in REVIEW_STATUS_NAMES.items():
        given = F.when(given == old, new).otherwise(given)
    return given


def _fault() -> Column:
    """Why a review's own fields don't do; null if they do. Fields are trimmed before."""
    return (F.when(F.col("finding_type") == "", F.lit("missing finding_type"))
            .when(~F.col("severity").isin(*REVIEW_SEVERITIES), F.concat(F.lit("invalid severity "), "severity"))
            .when(~F.col("status").isin(*REVIEW_STATUSES), F.concat(F.lit("invalid status "), "status"))
            .when(F.col("note") == "", F.lit("missing note")).when(F.col("recommendation") == "", F.lit("missing recommendation")))


FIELDS = ("finding_type", "severity", "status", "note", "recommendation")


def _cleaned(rows: DataFrame, *keep: str) -> DataFrame:
    trimmed = [F.trim(F.coalesce(f, F.lit(""))).alias(f) for f in ("finding_type", "note", "recommendation")]
    return rows.select(*keep, F.trim(F.coalesce("cluster_id", F.lit(""))).alias("cluster_id"), *trimmed,
                       F.lower(F.trim(F.coalesce("severity", F.lit("")))).alias("severity"), _status("status").alias("status"))


def merged_reviews(stored_rows: DataFrame, updates: DataFrame, new: DataFrame, clusters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reviews (one per cluster of `clusters`) and errors (kind, position, error).

    stored_rows: cluster_id, run_at, position and FIELDS: the latest run counts, of equal ones the later row. updates and
    new: cluster_id, position and FIELDS. An update needs a stored review, a new one none; of several for a cluster the first
    good one counts. Clusters without a review get a validated one.
    """
    known = clusters.select("cluster_id").distinct()
    kept = _cleaned(stored_rows, "run_at", "position").join(known, "cluster_id", "left_semi")
    latest = kept.groupBy("cluster_id").agg(F.max_by(F.struct(*FIELDS), F.struct(
        F.coalesce("run_at", F.lit("0001-01-01").cast("timestamp")), "position")).alias("r"))
    given = _cleaned(updates, "position").withColumn("kind", F.lit("update")).unionByName(
        _cleaned(new, "position").withColumn("kind", F.lit("new")))
    marked = given.join(known.withColumn("known", F.lit(True)), "cluster_id", "left").join(
        latest.select("cluster_id", F.lit(True).alias("reviewed")), "cluster_id", "left")
    early = (F.when(F.col("cluster_id") == "", F.lit("missing cluster_id"))
             .when((F.col("kind") == "new") & F.col("known").isNull(), F.concat(F.lit("unknown cluster "), "cluster_id"))
             .when((F.col("kind") == "new") & F.col("reviewed").isNotNull(), F.lit("has a review, use an update"))
             .when((F.col("kind") == "update") & F.col("reviewed").isNull(), F.lit("has no review, use a new one")))
    judged = stored(marked.withColumn("early", early).withColumn("fault", _fault()), "reviews")
    good = judged.where("early is null and fault is null")
    first = stored(good.groupBy("cluster_id").agg(F.min_by(F.struct(*FIELDS), "position").alias("r"), F.min("position").alias("chosen")), "chosen")
    errors = judged.join(first.select("cluster_id", "chosen"), "cluster_id", "left").select("kind", "position", F.coalesce(
        "early", F.when(F.col("position") > F.col("chosen"), F.lit("duplicate cluster_id")), "fault").alias("error")).where("error is not null")
    touched = first.select("cluster_id", "r")
    rest = latest.join(touched, "cluster_id", "left_anti")
    covered = touched.unionByName(rest)
    default = F.struct(*[F.lit(v).alias(f) for f, v in zip(FIELDS, REVIEW_BACKFILL)])
    missing = known.join(covered, "cluster_id", "left_anti").select("cluster_id", default.alias("r"))
    return covered.unionByName(missing).select("cluster_id", *[F.col(f"r.{f}").alias(f) for f in FIELDS]), errors
