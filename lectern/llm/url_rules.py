"""URL filtering by given rules, and by association rules mined from labelled URLs.

A URL's tokens are the parts of its host, its top-level domain, the parts of its path that are no numbers, its query
keys and its scheme. Spark's FP-growth finds token combinations that are frequent among labelled URLs together with
a label; rules under the confidence and support bounds or no better than chance go, and so does a rule that a shorter one with at least its
confidence implies. Rules are indexed by their rarest token: a URL's tokens meet the index by an equality join, and a
rule that is met is checked for its other tokens. Distinct token sets are matched once, whatever number of URLs share
one. Tokens that stand in the same labelled URLs are one item, so that keys which always come together don't multiply
combinations; a URL has an item if it has one of its tokens. Given rules decide first; then the mined rule of the highest confidence (ties: support, then block); else allow.

Defined results: null URLs, or those without `://`, have an empty host and path, no rule, and are allowed; repeated
rows give repeated results; a null label is no label. Empty tables give no rows; without labels nothing is mined.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import stored, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"),
         ("allow", "org", "/fr/"))
SUPPORT, CONFIDENCE = 0.002, 0.7
LABELS = {"=block": "block", "=allow": "allow"}


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as verdict and text; null if none does."""
    cases = []
    for verdict, name, start in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(start))
        cases.append(F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(name + start).alias("rule"))))
    return F.coalesce(*cases)


def tokens_of(url: Column) -> Column:
    """Sorted distinct tokens, each behind a letter for where it stands."""
    def marked(mark: str, parts: Column) -> Column:
        return F.transform(parts, lambda p: F.concat(F.lit(mark), p))

    host, text = host_of(url), F.coalesce(url, F.lit(""))
    top = F.regexp_extract(host, r"([^.]*)$", 1)
    name = F.split(F.regexp_replace(host, r"\.?[^.]*$", ""), r"[.-]")
    path = F.filter(F.split(F.lower(path_of(url)), r"[/._-]"), lambda p: ~p.rlike(r"^[0-9]*$"))
    keys = F.regexp_extract_all(text, F.lit(r"[?&]([^=&#]+)"), F.lit(1))
    scheme = F.array(F.lower(F.regexp_extract(text, "^([A-Za-z]+)://", 1)))
    everything = F.concat(marked("h:", name), marked("t:", F.array(top)), marked("p:", path), marked("q:", keys),
                          marked("s:", scheme))
    return F.array_sort(F.array_distinct(F.filter(everything, lambda t: F.length(t) > 2)))


def equal_tokens(labelled: DataFrame) -> DataFrame:
    """(row, tokens, blocked) -> token, item: tokens that stand in the same rows as a smaller one, and the smallest.

    Two sets of rows count as the same if their sizes and two 64-bit digests agree."""
    held = labelled.where("blocked is not null").select("row", F.explode("tokens").alias("token")).groupBy("token").agg(
        F.count("*").alias("n"), F.bit_xor(F.xxhash64("row")).alias("x"), F.bit_xor(F.xxhash64("row", F.lit(1))).alias("y"))
    first = held.groupBy("n", "x", "y").agg(F.min("token").alias("item"), F.count("*").alias("tokens")).where("tokens > 1")
    return held.join(first, ["n", "x", "y"]).where("token <> item").select("token", "item")


def with_items(sets: DataFrame, equal: DataFrame, key: list[str]) -> DataFrame:
    """sets, distinct by key, with `items`: their tokens with equal ones put together."""
    items = sets.select(*key, F.explode_outer("tokens").alias("token")).join(equal, "token", "left")
    return items.groupBy(*key).agg(F.array_sort(F.collect_set(F.coalesce("item", "token"))).alias("items"))


def mined(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """(tokens, blocked) -> rules: antecedent, verdict, confidence, support."""
    rows = labelled.where("blocked is not null").select(F.concat(
        F.filter("tokens", lambda t: ~F.startswith(t, F.lit("="))),
        F.array(F.when(F.col("blocked"), "=block").otherwise("=allow"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(rows)
    verdicts = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    rules = model.associationRules.where(F.col("consequent")[0].isin(list(LABELS))).where(
        ~F.exists("antecedent", lambda t: t.isin(list(LABELS)))).select(
        F.array_sort("antecedent").alias("antecedent"), verdicts[F.col("consequent")[0]].alias("verdict"),
        "confidence", "support", "lift").where("lift > 1").drop("lift")
    rules = stored(rules, "rules")
    # a rule is implied by one with a token less: look up each rule without each of its tokens
    parts = rules.where(F.size("antecedent") > 1).select("antecedent", "verdict", "confidence", F.explode(F.transform(
        "antecedent", lambda t: F.array_remove("antecedent", t))).alias("shorter"))
    shorter = rules.select(F.col("antecedent").alias("shorter"), "verdict", F.col("confidence").alias("had"))
    implied = parts.join(shorter, ["shorter", "verdict"]).where("had >= confidence").select("antecedent", "verdict")
    return rules.join(implied, ["antecedent", "verdict"], "left_anti")


def matched(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct token sets (tokens, and items if they differ) -> tokens, verdict, antecedent, confidence of the best rule;
    only sets that have one."""
    sets = sets if "items" in sets.columns else sets.withColumn("items", F.col("tokens"))
    common = rules.select(F.explode("antecedent").alias("token")).groupBy("token").count()
    met = rules.select("*", F.explode("antecedent").alias("token")).join(common, "token")
    index = met.groupBy("antecedent", "verdict").agg(
        F.min_by("token", F.struct("count", "token")).alias("token"), F.max("confidence").alias("confidence"),
        F.max("support").alias("support"))
    found = sets.select("tokens", "items", F.explode("items").alias("token")).join(index, "token").where(
        F.size(F.array_except("antecedent", "items")) == 0)
    best = F.struct("confidence", "support", (F.col("verdict") == "block").alias("b"),
                    F.negative(F.size("antecedent")).alias("s"), "antecedent", "verdict")
    return found.groupBy("tokens").agg(F.max(best).alias("r")).select("tokens", "r.verdict", "r.antecedent", "r.confidence")


def judged(urls: DataFrame, labels: DataFrame | None, rules=RULES, url: str = "url") -> DataFrame:
    """urls with host, path, rule, verdict, mined (antecedent of the mined rule that decided, else null).

    labels: rows (url, blocked). URLs that a given rule fits are labelled by it.
    """
    columns = [c for c in urls.columns if c not in ("host", "path", "rule", "verdict", "mined")]
    parts = (host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    rows = urls.select(*columns, *parts).withColumns({
        "__rule": rule_of(F.col("host"), F.col("path"), rules), "__tokens": tokens_of(F.col(url))})
    known = [rows.where("__rule is not null").select(
        F.col("__tokens").alias("tokens"), (F.col("__rule.verdict") == "block").alias("blocked"))]
    if labels is not None:
        other = rule_of(host_of(F.col("url")), path_of(F.col("url")), rules)
        known.append(labels.where(other.isNull()).select(tokens_of(F.col("url")).alias("tokens"), "blocked"))
    labelled = stored(reduce(DataFrame.union, known).where("blocked is not null").withColumn("row", F.monotonically_increasing_id()), "labelled")
    equal = stored(equal_tokens(labelled), "equal")
    found = mined(with_items(labelled, equal, ["row", "blocked"]).select(F.col("items").alias("tokens"), "blocked"))
    sets = rows.where("__rule is null").select(F.col("__tokens").alias("tokens")).distinct()
    best = matched(with_items(sets, equal, ["tokens"]), found).select(F.col("tokens").alias("__tokens"), F.col("verdict").alias("__verdict"),
                                       F.col("antecedent").alias("__antecedent"))
    free = rows.where("__rule is null").join(best, "__tokens", "left")
    ruled = rows.where("__rule is not null").select(
        *columns, "host", "path", F.col("__rule.rule").alias("rule"), F.col("__rule.verdict").alias("verdict"),
        F.lit(None).cast("array<string>").alias("mined"))
    return ruled.union(free.select(
        *columns, "host", "path", F.lit(None).cast("string").alias("rule"),
        F.coalesce("__verdict", F.lit("allow")).alias("verdict"), F.col("__antecedent").alias("mined")))


def query(spark, sf_dir: str) -> DataFrame:
    """Verdict on every page. Pages are labelled by the document whose number ends their path."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    number = F.regexp_extract(path_of(F.col("url")), r"/([0-9]{1,18})(?:\.html)?/?$", 1).try_cast("long")
    labels = pages.withColumn("doc_id", number).join(table(spark, sf_dir, "labels"), "doc_id").select(
        "url", ((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("blocked"))
    return judged(pages, labels).select("page_id", "host", "path", "rule", "verdict",
                                        F.array_join("mined", " ").alias("mined"))
