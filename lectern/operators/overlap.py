"""Which annotations a chunk repeats: exact phrase-window matching.

A span of four or more words matches when any window of six words (all words
when the span is shorter) occurs in the chunk's text, a shorter span when all
of it does. Inner words of such an occurrence are whole words, so they are an
equality key; the words at its ends are then compared literally. A span of two
words is keyed by the letters around its gap, a single long word by its first
letters, which long words of the text offer at every place.

Spans and chunks are shuffled once, as texts, and sorted by page. A task keys
the spans of one page at a time and reads the page's chunks past them, so
neither windows nor positions are ever rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import matching_form

PAGE = ["material_id", "page"]

SHORTEST, LETTERS, BATCH = 10, 4, 50_000


def _key(parts: tuple[str, ...]) -> tuple[str, ...]:
    """What an occurrence has word by word: the inner words; of two words the letters around the gap."""
    return parts[1:-1] or (parts[0][-1:], parts[1][:1])


class _Spans:
    """Keyed windows of one page's spans; each distinct window holds the annotations that have it."""

    def __init__(self) -> None:
        self.windows: dict[int, dict[tuple[str, ...], dict[tuple[str, str], list[str]]]] = {}  # by their number of words
        self.words: dict[str, dict[str, list[str]]] = {}

    def add(self, annotation: str, span: str) -> None:
        if len(span) < SHORTEST:
            return
        words = span.split(" ")
        width = min(len(words), 6)
        if width == 1:
            self.words.setdefault(span[:LETTERS], {}).setdefault(span, []).append(annotation)
            return
        keyed = self.windows.setdefault(width, {})
        for parts in zip(*(words[k:] for k in range(width))):
            keyed.setdefault(_key(parts), {}).setdefault((parts[0], parts[-1]), []).append(annotation)

    def met(self, body: str) -> set[str]:
        """Annotations with a window that occurs in the body."""
        words, found = body.split(" "), {}
        for width, keyed in self.windows.items():
            for parts in zip(*(words[k:] for k in range(width))):
                for (first, last), annotations in keyed.get(_key(parts), {}).items():
                    if parts[0].endswith(first) and parts[-1].startswith(last):
                        found[id(annotations)] = annotations
        for w in words if self.words else ():
            for i in range(len(w) - SHORTEST + 1):
                for span, annotations in self.words.get(w[i:i + LETTERS], {}).items():
                    if w.startswith(span, i):
                        found[id(annotations)] = annotations
        return set().union(*found.values())


def _matched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come by page, spans before chunks, chunks by id; a page may go on in the next batch."""
    page = chunk = None
    spans, told, out = _Spans(), set(), []
    for batch in batches:
        for material, number, is_chunk, key, text in batch.itertuples(index=False, name=None):
            if (material, number) != page:
                page, chunk, spans = (material, number), None, _Spans()
            if not is_chunk:
                spans.add(key, text)
                continue
            if key != chunk:
                chunk, told = key, set()
            new = spans.met(text) - told
            told |= new
            out.extend((material, number, key, annotation) for annotation in new)
            while len(out) >= BATCH:
                yield pd.DataFrame(out[:BATCH], columns=[*PAGE, "chunk_id", "annotation_id"])
                out = out[BATCH:]
    if out:
        yield pd.DataFrame(out, columns=[*PAGE, "chunk_id", "annotation_id"])


def overlaps(chunks: DataFrame, annotations: DataFrame) -> DataFrame:
    """Distinct (material, page, chunk, annotation) matches.

    ``chunks``: material_id, page, chunk_id, text. ``annotations``:
    material_id, page, annotation_id, quoted_text, type.
    """
    spans = annotations.where(F.col("type").isin("highlight", "underline") & (F.coalesce("quoted_text", F.lit("")) != "")).select(
        *PAGE, F.lit(False).alias("is_chunk"), F.col("annotation_id").alias("key"), matching_form(F.col("quoted_text")).alias("text"))
    texts = chunks.select(*PAGE, F.lit(True).alias("is_chunk"), F.col("chunk_id").alias("key"), matching_form(F.col("text")).alias("text"))
    both = spans.union(texts).where("material_id is not null and page is not null")
    kinds = both.schema
    schema = ", ".join([*[f"{c} {kinds[c].dataType.simpleString()}" for c in PAGE], "chunk_id string", "annotation_id string"])
    return both.repartition(*PAGE).sortWithinPartitions(*PAGE, "is_chunk", "key").mapInPandas(_matched, schema)
