"""Responses that move local clusters between bridges: partial acceptance, then the bridges they lead to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import names as N
from lectern.operators.tables import stored

ALIASES = 8
TEXTS = "array<string>"


def accepted_rows(links: DataFrame, new: DataFrame, existing: DataFrame, pending: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of a response that can be applied, and errors of the others (kind, position, error).

    links: position, bridge_id, canonical_name, descriptor, aliases, members (cluster ids in order). new: the same without
    bridge_id. A row is refused whole for an unknown bridge, a missing name, or a member that is blank or not pending.
    """
    rows = links.select(F.lit("link").alias("kind"), "position", F.trim(F.coalesce("bridge_id", F.lit(""))).alias("bridge_id"), "canonical_name",
                        "descriptor", "aliases", "members").unionByName(
        new.select(F.lit("new").alias("kind"), "position", F.lit("").alias("bridge_id"), "canonical_name", "descriptor", "aliases", "members"))
    rows = stored(rows.withColumns({
        "canonical_name": F.trim(F.coalesce("canonical_name", F.lit(""))), "descriptor": F.trim(F.coalesce("descriptor", F.lit(""))),
        "members": F.coalesce("members", F.array().cast(TEXTS)), "aliases": F.coalesce("aliases", F.array().cast(TEXTS))}), "response")
    known = existing.select("bridge_id", F.lit(True).alias("known")).distinct()
    asked = rows.select("kind", "position", F.posexplode("members").alias("at", "cluster_id")).withColumn("cluster_id", F.trim(F.coalesce("cluster_id", F.lit(""))))
    bad = asked.join(pending.select("cluster_id", F.lit(True).alias("pending")).distinct(), "cluster_id", "left").where("pending is null")
    first = bad.groupBy("kind", "position").agg(F.min_by("cluster_id", "at").alias("cluster_id"), F.min("at").alias("at"))
    member = first.select("kind", "position", F.when(F.col("cluster_id") == "", F.concat(
        F.lit("member "), (F.col("at") + 1).cast("string"), F.lit(" is missing cluster_id"))).otherwise(F.concat(
            F.lit("member "), (F.col("at") + 1).cast("string"), F.lit(" references unknown pending cluster_id '"), "cluster_id", F.lit("'"))).alias("member"))
    judged = rows.join(known, "bridge_id", "left").join(member, ["kind", "position"], "left").withColumn("error", F.coalesce(
        F.when((F.col("kind") == "link") & (F.col("bridge_id") == ""), F.lit("missing bridge_id")),
        F.when((F.col("kind") == "link") & F.col("known").isNull(), F.concat(F.lit("unknown bridge_id '"), "bridge_id", F.lit("'"))),
        F.when((F.col("kind") == "new") & (F.col("canonical_name") == ""), F.lit("missing canonical_name")),
        "member", F.when(F.size("members") == 0, F.lit("no valid members"))))
    return (judged.where("error is null").select(*rows.columns), judged.where("error is not null").select("kind", "position", "error"))


def _last_given(name: str) -> Column:
    """The last link that gives a value."""
    return F.max_by(name, F.when(F.col(name) != "", F.col("position")))


def finalized(existing: DataFrame, held: DataFrame, accepted: DataFrame, clusters: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Bridges after a response, their members, and the ones of several domains, which are refused.

    existing: position, bridge_id, canonical_name, slug, descriptor, aliases. held: bridge_id, cluster_id, position. accepted:
    rows of accepted_rows(). clusters: cluster_id, domain, collection, canonical_name, confidence. A cluster that any
    accepted row names leaves the bridges that held it. What falls below two members of two collections, or three of one,
    collapses. New ids and slugs are numbered past those in use.
    """
    moved = accepted.select(F.explode("members").alias("cluster_id")).select(F.trim("cluster_id").alias("cluster_id")).distinct()
    stays = held.join(moved, "cluster_id", "left_anti").select(F.concat(F.lit("b/"), "bridge_id").alias("row"), "cluster_id", F.struct(
        F.lit(0).alias("late"), F.col("position").cast("long").alias("position"), F.lit(0).alias("at")).alias("spot"))
    label = F.when(F.col("kind") == "link", F.concat(F.lit("b/"), "bridge_id")).otherwise(F.concat(F.lit("n/"), F.col("position").cast("string")))
    comes = accepted.select(label.alias("row"), "position", F.posexplode("members").alias("at", "cluster_id")).select(
        "row", F.trim("cluster_id").alias("cluster_id"), F.struct(F.lit(1).alias("late"), F.col("position").cast("long").alias("position"), "at").alias("spot"))
    one = stays.unionByName(comes).groupBy("row", "cluster_id").agg(F.min("spot").alias("spot"))
    members = stored(one.join(clusters.withColumn("collection_key", N.collection_key(F.col("domain"), F.col("collection"))), "cluster_id"), "members")
    facts = members.groupBy("row").agg(
        F.min("domain").alias("domain"), F.max("domain").alias("other"), F.count("*").alias("members"), F.count_distinct("collection_key").alias("collections"),
        F.min_by("canonical_name", "spot").alias("first_name"), F.bround(F.avg("confidence"), 4).alias("confidence"))
    links = accepted.where("kind = 'link'").groupBy("bridge_id").agg(
        _last_given("canonical_name").alias("new_name"), _last_given("descriptor").alias("new_descriptor"),
        F.max_by("aliases", F.when(F.size("aliases") > 0, F.col("position"))).alias("new_aliases"))
    old = existing.join(links, "bridge_id", "left").select(
        F.concat(F.lit("b/"), "bridge_id").alias("row"), F.struct(F.lit(0), F.col("position").cast("long")).alias("order"), "bridge_id",
        F.coalesce("new_name", F.trim(F.coalesce("canonical_name", F.lit("")))).alias("canonical_name"), F.trim(F.coalesce("slug", F.lit(""))).alias("slug"),
        F.coalesce("new_descriptor", F.trim(F.coalesce("descriptor", F.lit("")))).alias("descriptor"), F.coalesce("new_aliases", "aliases").alias("aliases"))
    made = accepted.where("kind = 'new'").select(
        label.alias("row"), F.struct(F.lit(1), F.col("position").cast("long")).alias("order"), F.lit("").alias("bridge_id"), "canonical_name",
        F.lit("").alias("slug"), "descriptor", "aliases")
    full = stored(old.union(made).join(facts, "row"), "bridges")
    mixed = full.where("domain <> other").select("row", F.lit("members must all belong to the same domain").alias("error"))
    name = F.coalesce(F.nullif("canonical_name", F.lit("")), "first_name")
    prefix = F.concat(F.lit("global_bridge__"), "domain", F.lit("__"))
    good = full.where("domain = other and members >= if(collections >= 2, 2, 3)").withColumn("canonical_name", name).withColumn(
        "base", F.coalesce(F.nullif("slug", F.lit("")), F.nullif(N.slugify(F.col("canonical_name")), F.lit("")), F.lit("global-bridge"))).withColumn(
            "kept", F.startswith("bridge_id", prefix))
    kept = good.where("kept").withColumn("slug", F.coalesce(F.nullif("slug", F.lit("")), F.expr("substr(bridge_id, length(domain) + 18)")))
    fresh = good.where("not kept")
    # of each base the free numbers in order: as many as are needed, past those that kept ids use
    used = kept.select("domain", F.expr("substr(bridge_id, length(domain) + 18)").alias("slug"))
    taken = used.groupBy("domain").agg(F.count("*").alias("taken"))
    needed = fresh.groupBy("domain", "base").agg(F.count("*").alias("needed")).join(taken, "domain", "left")
    number = Window.partitionBy("domain", "base").orderBy("number")
    free = needed.select("domain", "base", F.explode(F.sequence(F.lit(1).cast("long"), F.col("needed") + F.coalesce("taken", F.lit(0)))).alias("number")).withColumn(
        "slug", F.when(F.col("number") == 1, F.col("base")).otherwise(F.concat_ws("-", "base", F.col("number").cast("string"))))
    free = free.join(used, ["domain", "slug"], "left_anti").withColumn("turn", F.row_number().over(number))
    turns = fresh.drop("slug").withColumn("turn", F.row_number().over(Window.partitionBy("domain", "base").orderBy("order")))
    named = turns.join(free.drop("number"), ["domain", "base", "turn"]).withColumn("bridge_id", F.concat(prefix, "slug"))
    columns = ["row", "bridge_id", "domain", "canonical_name", "slug", "descriptor", "aliases", "members", "collections", "confidence"]
    out = stored(kept.select(*columns).unionByName(named.select(*columns)), "final")
    ids = out.select("row", "bridge_id")
    places = members.join(ids, "row")
    given = out.select("row", "canonical_name", F.posexplode("aliases").alias("at", "alias")).select("row", "canonical_name", "alias", F.struct(
        F.lit(-1).alias("late"), F.col("at").cast("long").alias("position"), F.lit(0).alias("at")).alias("spot"))
    names = given.unionByName(members.select("row", F.col("canonical_name").alias("alias"), "spot").join(out.select("row", "canonical_name"), "row"))
    spelled = names.where("trim(alias) <> ''").withColumn("folded", F.lower(F.trim("alias"))).where("folded <> lower(canonical_name)")
    chosen = spelled.groupBy("row", "folded").agg(F.min_by(F.trim("alias"), "spot").alias("alias"), F.min("spot").alias("spot"))
    top = chosen.withColumn("n", F.row_number().over(Window.partitionBy("row").orderBy("spot", "folded"))).where(F.col("n") <= ALIASES)
    listed = top.groupBy("row").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "alias"))), lambda a: a["alias"]), "|").alias("aliases"))
    bridges = out.drop("aliases").join(listed, "row", "left").select(
        "bridge_id", "domain", "canonical_name", "slug", "descriptor", F.coalesce("aliases", F.lit("")).alias("aliases"), "members", "collections",
        "confidence", N.bridge_path(F.col("domain"), F.col("slug")).alias("wiki_path"))
    return bridges, places.select("bridge_id", "cluster_id", "collection_key"), mixed
