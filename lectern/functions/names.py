"""Names, keys, slugs, paths and links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.text import SPACE_RUN, bind, squeeze, strip, text_or_empty


def _drop_last(c: Column, n: int) -> Column:
    return c.substr(F.lit(1), F.length(c) - n)


def singular(word: Column) -> Column:
    """English singular of one lower-case word by its ending."""
    size = F.length(word)
    cut_two = word.endswith("ses") | word.endswith("xes") | word.endswith("zes") | word.endswith("ches") | word.endswith("shes")
    keeps_s = word.endswith("ss") | word.endswith("us") | word.endswith("is")
    return (
        F.when((size <= 3) | ~word.endswith("s"), word)
        .when(word.endswith("ies") & (size > 4), F.concat(_drop_last(word, 3), F.lit("y")))
        .when(cut_two, _drop_last(word, 2))
        .when(keeps_s, word)
        .otherwise(_drop_last(word, 1))
    )


def concept_key(c: Column) -> Column:
    """Grouping key of a concept: folded case, last word made singular."""

    def keyed(key: Column) -> Column:
        last = F.substring_index(key, " ", -1)
        return F.concat(key.substr(F.lit(1), F.length(key) - F.length(last)), singular(last))

    return bind(squeeze(F.lower(text_or_empty(c))), keyed)


def cluster_name_key(c: Column) -> Column:
    """The clustering side's own key; it disagrees with concept_key by design."""
    key = squeeze(F.lower(text_or_empty(c)))
    size = F.length(key)
    return (
        F.when(key.endswith("ies") & (size > 4), F.concat(_drop_last(key, 3), F.lit("y")))
        .when(key.endswith("es") & (size > 3), _drop_last(key, 2))
        .when(key.endswith("s") & (size > 2), _drop_last(key, 1))
        .otherwise(key)
    )


def slugify(c: Column) -> Column:
    dashed = F.replace(strip(F.lower(text_or_empty(c))), F.lit(" "), F.lit("-"))
    kept = F.regexp_replace(dashed, "[^a-z0-9-]+", "")
    return F.btrim(F.regexp_replace(kept, "-{2,}", "-"), F.lit("-"))


def default_scope(value: Column, fallback: str) -> Column:
    return F.coalesce(F.nullif(strip(text_or_empty(value)), F.lit("")), F.lit(fallback))


def domain_or_default(c: Column) -> Column:
    return default_scope(c, "practice")


def collection_or_default(c: Column) -> Column:
    return default_scope(c, "_general")


def collection_key(domain: Column, collection: Column) -> Column:
    return F.concat_ws("__", domain_or_default(domain), collection_or_default(collection))


def material_path(domain: Column, collection: Column, material: Column) -> Column:
    return F.concat(
        F.lit("wiki/"), domain_or_default(domain), F.lit("/"), collection_or_default(collection),
        F.lit("/"), material.cast("string"), F.lit(".md"),
    )


def concept_path(domain: Column, collection: Column, slug: Column) -> Column:
    return F.concat(
        F.lit("wiki/"), domain_or_default(domain), F.lit("/"), collection_or_default(collection),
        F.lit("/concepts/"), slug, F.lit(".md"),
    )


def bridge_path(domain: Column, slug: Column) -> Column:
    return F.concat(
        F.lit("wiki/"), default_scope(domain, "shared"), F.lit("/bridge-concepts/"), slug, F.lit(".md")
    )


def titled(c: Column) -> Column:
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))


def collection_title(domain: Column, collection: Column) -> Column:
    return F.concat(titled(domain), F.lit(" / "), titled(collection))


def ascii_words(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text_or_empty(c)), F.lit("[a-z0-9]+"), F.lit(0)))


def match_score(text: Column, references: Column) -> Column:
    """(best word overlap, longest reference with that overlap)."""
    words = ascii_words(text)
    start = F.struct(F.lit(0).alias("overlap"), F.lit(0).alias("chars"))
    scored = F.transform(
        references,
        lambda r: F.struct(
            F.size(F.array_intersect(words, ascii_words(r))).alias("overlap"),
            F.length(r).alias("chars"),
        ),
    )
    return F.greatest(start, F.coalesce(F.array_max(scored), start))


def markdown_links(c: Column) -> Column:
    """Targets of inline links, code fences and images left out."""
    plain = F.regexp_replace(text_or_empty(c), r"(?s)```.*?```", "")
    targets = F.regexp_extract_all(plain, F.lit(r"(?<!!)\[[^\]]+\]\(([^)]+)\)"), F.lit(1))
    return F.filter(F.transform(targets, strip), lambda t: t != "")


def _normal_path(path: Column) -> Column:
    """Resolve '.' and '..' segments; null when the path leaves the root."""
    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(False).alias("out"))

    def step(acc: Column, seg: Column) -> Column:
        parts, out = acc["parts"], acc["out"]
        up = seg == ".."
        skip = seg.isin("", ".")
        shorter = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
        return F.struct(
            F.when(skip, parts).when(up, shorter).otherwise(F.concat(parts, F.array(seg))).alias("parts"),
            (out | (up & (F.size(parts) == 0))).alias("out"),
        )

    return F.aggregate(
        F.split(path, "/"), start, step,
        lambda acc: F.when(~acc["out"], F.array_join(acc["parts"], "/")),
    )


def resolve_link(page_path: Column, target: Column) -> Column:
    """Root-relative path of a link, or null for anchors and outside targets."""
    bare = strip(F.split_part(target, F.lit("#"), F.lit(1)))
    clean = F.coalesce(F.try_url_decode(F.replace(bare, F.lit("+"), F.lit("%2B"))), bare)
    folder = F.regexp_replace(page_path, "[^/]*$", "")
    joined = F.when(clean.startswith("wiki/"), clean).otherwise(F.concat(folder, clean))
    outside = (
        target.startswith("#") | target.rlike("^(https?://|mailto:|file://)")
        | (clean == "") | clean.startswith("/")
    )
    return F.when(~outside, _normal_path(joined))


def relative_link(from_path: Column, to_path: Column) -> Column:
    """Link text from one page to another through their common folder."""
    here = F.filter(F.split(F.regexp_replace(from_path, "[^/]*$", ""), "/"), lambda s: s != "")
    there = F.split(to_path, "/")
    pairs = F.zip_with(here, F.slice(there, F.lit(1), F.size(here)), lambda a, b: F.coalesce(a == b, F.lit(False)))
    shared = F.coalesce(
        F.nullif(F.array_position(pairs, F.lit(False)), F.lit(0)) - 1, F.size(here)
    ).cast("int")
    ups = F.repeat(F.lit("../"), F.size(here) - shared)
    rest = F.slice(there, shared + 1, F.greatest(F.size(there) - shared, F.lit(0)))
    return F.concat(ups, F.array_join(rest, "/"))


def safe_relative(c: Column) -> Column:
    """True for a non-empty relative path that cannot climb out of its root."""
    path = text_or_empty(c)
    return (path != "") & ~path.startswith("/") & ~path.rlike(r"(^|/)\.\.(/|$)")


def single_spaced(c: Column) -> Column:
    return F.regexp_replace(c, SPACE_RUN, " ")
