"""Reading loosely formatted JSON answers."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lectern.functions.fixed import CONTENT_CLASSES
from lectern.functions.lists import parse_tolerant
from lectern.functions.text import squeeze, strip, text_or_empty


@F.pandas_udf(StringType())
def json_prefix(texts: pd.Series) -> pd.Series:
    """First JSON value of a text with trailing noise, as JSON text."""
    decoder = json.JSONDecoder()

    def first(text: str) -> str | None:
        try:
            return json.dumps(decoder.raw_decode(text.lstrip())[0], ensure_ascii=False)
        except ValueError:
            return None

    return texts.map(first, na_action="ignore")


def parse_or_prefix(c: Column) -> Column:
    """Variant of the text as JSON: whole, inside a fence, or its first value."""
    return F.coalesce(parse_tolerant(c), F.try_parse_json(json_prefix(c)))


def chunk_responses(objects: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """Normalised (chunk_id, summary, keywords, content_class) answers.

    Short and long field names mean the same; answers without an id or any
    usable field are dropped.
    """
    v = F.try_parse_json(F.col(column))
    text = lambda path: F.nullif(strip(text_or_empty(F.try_variant_get(v, path, "string"))), F.lit(""))
    words = F.coalesce(F.try_variant_get(v, "$.kw", "array<string>"), F.try_variant_get(v, "$.keywords", "array<string>"))
    kept = F.slice(F.filter(F.transform(words, squeeze), lambda w: w != ""), 1, 3)
    kind = F.coalesce(text("$.cls"), text("$.content_class"))
    rows = objects.select(
        *keep, F.coalesce(text("$.id"), text("$.chunk_id")).alias("chunk_id"),
        squeeze(F.coalesce(text("$.s"), text("$.summary"), F.lit(""))).alias("summary"),
        F.coalesce(F.array_join(kept, "|"), F.lit("")).alias("keywords"),
        F.when(kind.isin(*CONTENT_CLASSES), kind).otherwise("").alias("content_class"))
    return rows.where("chunk_id IS NOT NULL AND (summary != '' OR keywords != '' OR content_class != '')")


def clean_descriptor(raw: Column) -> Column:
    """One plain line out of a fenced, quoted, labelled or JSON descriptor."""
    bare = strip(F.regexp_replace(F.regexp_replace(strip(raw), r"^```[a-zA-Z0-9_-]*\s*", ""), r"\s*```$", ""))
    named = F.try_variant_get(F.try_parse_json(bare), "$.descriptor", "string")
    text = F.coalesce(named, bare)
    text = strip(F.regexp_replace(text, r"(?i)^\s*(descriptor|description|summary)\s*:\s*", ""))
    text = strip(F.btrim(F.btrim(text, F.lit('"')), F.lit("'")))
    return F.array_join(F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != ""), " ")
