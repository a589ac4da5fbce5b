"""Document-type score from fixed text and file-name signals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.fixed import DOCUMENT_TYPE_MIN_SCORE, DOCUMENT_TYPE_SIGNALS
from lectern.functions.text import SOFT_HYPHEN, bind, strip, text_or_empty


def document_type(text: Column, file_name: Column) -> Column:
    """Best-scoring type, the first declared on ties; 'unknown' below the minimum."""
    body = F.lower(F.translate(text_or_empty(text), SOFT_HYPHEN, ""))
    pair = F.struct(body.alias("body"), F.lower(text_or_empty(file_name)).alias("name"))

    def points(source: Column, signals: tuple[str, ...], worth: int) -> Column:
        return reduce(lambda a, b: a + b, (F.when(source.contains(s), worth).otherwise(0) for s in signals))

    def best(p: Column) -> Column:
        scores = [
            F.struct(
                (points(p["body"], text_signals, 1) + points(p["name"], name_signals, 2)).alias("score"),
                F.lit(-order).alias("order"), F.lit(kind).alias("kind"))
            for order, (kind, text_signals, name_signals) in enumerate(DOCUMENT_TYPE_SIGNALS)
        ]
        return bind(
            F.array_max(F.array(*scores)),
            lambda top: F.when(top["score"] >= DOCUMENT_TYPE_MIN_SCORE, top["kind"]).otherwise("unknown"))

    return bind(pair, best)


def canonical_type(raw: Column) -> Column:
    """Blank and 'unknown' types count as one."""
    value = strip(text_or_empty(raw))
    return F.when(F.lower(value).isin("", "unknown"), "unknown").otherwise(value)
