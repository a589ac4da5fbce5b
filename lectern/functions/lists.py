"""Array, JSON and hash expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.text import bind, strip, text_or_empty

STRINGS = "array<string>"


def json_list(c: Column) -> Column:
    """JSON text to trimmed strings; anything that is not a list gives []."""
    parsed = F.from_json(F.when(text_or_empty(c).rlike(r"^\s*\["), c), STRINGS)
    items = F.coalesce(parsed, F.array().cast(STRINGS))
    return F.filter(F.transform(items, lambda x: strip(text_or_empty(x))), lambda x: x != "")


def dedupe_folded(values: Column) -> Column:
    """First spelling of each value, compared trimmed and without case."""
    kept = F.filter(F.transform(values, lambda v: strip(text_or_empty(v))), lambda v: v != "")

    def firsts(items: Column) -> Column:
        folded = F.transform(items, lambda v: F.lower(v))
        return bind(folded, lambda keys: F.filter(
            items, lambda v, i: F.array_position(keys, F.get(keys, i)) == i + 1))

    return bind(kept, firsts)


def first_text(*candidates: Column) -> Column:
    """First candidate that is not blank, trimmed; empty text when all are."""
    options = [F.nullif(strip(text_or_empty(c)), F.lit("")) for c in candidates]
    return F.coalesce(*options, F.lit(""))


def head(values: Column) -> Column:
    return F.get(values, F.lit(0))


def flatten_value(field: Column) -> Column:
    """Text of an enriched field held as a variant: lists join with blanks."""
    listed = F.try_variant_get(field, "$.value", STRINGS)
    single = F.try_variant_get(field, "$.value", "string")
    return F.coalesce(F.array_join(listed, " "), single, F.lit(""))


def keyword_json(field: Column) -> Column:
    listed = F.try_variant_get(field, "$.value", STRINGS)
    single = F.try_variant_get(field, "$.value", "string")
    one = F.when(single.isNotNull(), F.to_json(F.array(single)))
    return F.coalesce(F.to_json(listed), one, F.lit("[]"))


def canonical_hash(*parts: Column) -> Column:
    """Sixteen hex digits over the parts as one JSON object: no value can run into the next, and null is not text."""
    fields = F.struct(*[p.cast("string").alias(f"p{i}") for i, p in enumerate(parts)])
    return F.substring(F.sha2(F.to_json(fields, {"ignoreNullFields": "false"}), 256), 1, 16)


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def material_id(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 12)


def set_digest(member_hash: Column, slices: int = 4, width: int = 12) -> Column:
    """Order-free digest of a set of hex hashes, mergeable across partitions.

    Adds slices of each member hash as exact integers, so no task ever holds
    the members; equal sets give equal digests whatever their order.
    """
    sums = [
        F.sum(F.conv(F.substring(member_hash, 1 + i * width, width), 16, 10).cast("decimal(20,0)"))
        for i in range(slices)
    ]
    rendered = [F.coalesce(s.cast("decimal(38,0)").cast("string"), F.lit("0")) for s in sums]
    return F.sha2(F.concat_ws(":", *rendered, F.count(member_hash).cast("string")), 256)


def overlap(a: Column, b: Column) -> Column:
    return F.arrays_overlap(a, b)


def disjoint_violations(*named: tuple[str, Column]) -> Column:
    """Names of list pairs that share an item, compared without case or padding."""
    folded = [
        (name, F.transform(values, lambda v: F.lower(strip(v)))) for name, values in named
    ]
    found = []
    for i, (left, a) in enumerate(folded):
        for right, b in folded[i + 1:]:
            found.append(F.when(F.arrays_overlap(a, b), F.lit(f"{left}/{right}")))
    return F.array_compact(F.array(*found))


def parse_tolerant(c: Column) -> Column:
    """JSON text, directly or from inside a code fence, as a variant."""
    fence = F.regexp_extract(text_or_empty(c), r"(?is)```(?:json|jsonl)?\s*(.*?)```", 1)
    return F.coalesce(F.try_parse_json(c), F.try_parse_json(F.nullif(strip(fence), F.lit(""))))


def json_objects(c: Column) -> Column:
    """Every flat {...} object found in free text that parses as JSON."""
    raw = F.regexp_extract_all(text_or_empty(c), F.lit(r"\{[^{}]*\}"), F.lit(0))
    return F.filter(raw, lambda o: F.try_parse_json(o).isNotNull())
