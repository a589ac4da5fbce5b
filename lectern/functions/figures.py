"""Geometry and content tests for extracted figures."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from lectern.functions.fixed import HINT_FULL_PAGE, HINT_INLINE, HINT_TINY, SCAN_ARTIFACT_PHRASES
from lectern.functions.text import strip, text_or_empty


def _side(box: Column, low: int, high: int) -> Column:
    return F.greatest(F.get(box, F.lit(high)) - F.get(box, F.lit(low)), F.lit(0.0))


def width(box: Column) -> Column:
    return F.when(F.size(box) == 4, _side(box, 0, 2)).otherwise(0.0)


def height(box: Column) -> Column:
    return F.when(F.size(box) == 4, _side(box, 1, 3)).otherwise(0.0)


def area(box: Column) -> Column:
    return width(box) * height(box)


def is_tiny(box: Column) -> Column:
    w, h = width(box), height(box)
    return (w > 0) & (h > 0) & ((w < 48) | (h < 48) | (w * h < 3500))


def is_full_page(box: Column) -> Column:
    corner = (F.get(box, F.lit(0)) <= 1.0) & (F.get(box, F.lit(1)) <= 1.0)
    return (F.size(box) == 4) & corner & (width(box) >= 400) & (height(box) >= 700)


def is_page_scan(page_width: Column, page_height: Column, text: Column, box: Column) -> Column:
    """Image covers the page, or nearly so with the page's shape and much text."""
    page_area = page_width * page_height
    coverage = F.when(page_area > 0, area(box) / page_area).otherwise(0.0)
    page_shape = F.when(page_height > 0, page_width / page_height).otherwise(0.0)
    shape = F.when(height(box) > 0, width(box) / height(box)).otherwise(0.0)
    alike = (page_shape > 0) & (shape > 0) & (F.abs(shape - page_shape) <= page_shape * 0.15)
    long_text = F.length(strip(text_or_empty(text))) >= 400
    return (F.size(box) == 4) & (coverage >= 0.9) | ((coverage >= 0.8) & long_text & alike)


def names_artifact(description: Column) -> Column:
    low = F.lower(strip(text_or_empty(description)))
    return reduce(lambda a, b: a | b, (low.contains(p) for p in SCAN_ARTIFACT_PHRASES))


def deletable(relevance: Column, method: Column, box: Column, description: Column) -> Column:
    """Figure that carries no substance and may be dropped."""
    plain = F.lower(strip(text_or_empty(relevance))).isin("decorative", "front_matter")
    artifact = (method == "embedded") & (is_tiny(box) | is_full_page(box)) & names_artifact(description)
    return plain | artifact


def hint(method: Column, box: Column, page_text: Column) -> Column:
    inline = (method == "embedded") & (F.length(strip(text_or_empty(page_text))) > 1200)
    return (
        F.when(is_full_page(box), HINT_FULL_PAGE).when(is_tiny(box), HINT_TINY)
        .when(inline, HINT_INLINE).otherwise("")
    )


def overlap_area(a: Column, b: Column) -> Column:
    def side(low: int, high: int) -> Column:
        right = F.least(F.get(a, F.lit(high)), F.get(b, F.lit(high)))
        left = F.greatest(F.get(a, F.lit(low)), F.get(b, F.lit(low)))
        return F.greatest(right - left, F.lit(0.0))

    return side(0, 2) * side(1, 3)


def mostly_covered(box: Column, others: Column, share: float = 0.5) -> Column:
    """True when one other box covers more than ``share`` of this one."""
    return F.exists(others, lambda o: (area(box) > 0) & (overlap_area(box, o) > area(box) * share))


def closure(boxes: list[list[float]]) -> list[list[float]]:
    """Merge touching boxes into their common bounds until none touch."""
    settled: list[list[float]] = []
    waiting = [list(b) for b in boxes]
    while waiting:
        box = waiting.pop()
        touching = [s for s in settled if not (s[2] < box[0] or box[2] < s[0] or s[3] < box[1] or box[3] < s[1])]
        if not touching:
            settled.append(box)
            continue
        settled = [s for s in settled if s not in touching]
        group = [*touching, box]
        waiting.append([min(b[0] for b in group), min(b[1] for b in group), max(b[2] for b in group), max(b[3] for b in group)])
    return sorted(settled)


@F.pandas_udf(ArrayType(ArrayType(DoubleType())))
def merge_boxes(pages: pd.Series) -> pd.Series:
    return pages.map(closure)


def merged_regions(rects: DataFrame, keys: list[str], margin: float = 20.0, salts: int = 16) -> DataFrame:
    """Regions of a page after merging rectangles closer than twice the margin.

    The result does not depend on merge order, so a page's rectangles are first
    merged within hash slices and the few survivors once more per page; a page
    with very many drawings is thus never held by one task unmerged.
    """
    grown = F.array(F.col("x0") - margin, F.col("y0") - margin, F.col("x1") + margin, F.col("y1") + margin)
    slices = rects.select(*keys, grown.alias("_box"), F.pmod(F.xxhash64("x0", "y0", "x1", "y1"), F.lit(salts)).alias("_salt"))
    partial = slices.groupBy(*keys, "_salt").agg(F.collect_list("_box").alias("_boxes"))
    partial = partial.select(*keys, F.explode(merge_boxes("_boxes")).alias("_box"))
    whole = partial.groupBy(*keys).agg(F.collect_list("_box").alias("_boxes"))
    merged = whole.select(*keys, F.explode(merge_boxes("_boxes")).alias("_box"))
    return merged.select(*keys, *[F.get("_box", F.lit(i)).alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))])
