"""Full-text matching and ranking over raw text columns.

Every document is tokenised inside its own row; term counts never leave the
row, so matching needs no shuffle. Corpus statistics are one scalar subquery
(partial aggregation, one row), and the ranked list is a top-k.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions.fixed import BM25_B, BM25_IDF_FLOOR, BM25_K1, QUERY_SYNTAX, STOP_WORDS
from lectern.functions.stem import stem, stem_tokens
from lectern.functions.text import fold_text, word_tokens



def _words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", fold_text(text))


def query_phrases(query: str) -> list[list[str]]:
    """Phrases a query asks for, any of which may match; [] matches nothing.

    Several plain words are alternatives without their stop words. Search
    syntax, upper-case operators or stop words alone make one phrase, and a
    word with punctuation is the phrase of its parts.
    """
    stripped = query.strip()
    if re.search(QUERY_SYNTAX, stripped):
        wanted = [stripped]
    else:
        words = stripped.split()
        content = [w for w in words if w.lower() not in STOP_WORDS]
        wanted = words if len(words) == 1 else (content or [stripped])
    return [p for p in map(_words, wanted) if p]


def phrase_count(tokens: Column, phrase: list[str]) -> Column:
    """Occurrences of the phrase in a token array."""
    if len(phrase) == 1:
        return F.size(F.filter(tokens, lambda t: t == phrase[0]))
    starts = F.sequence(F.lit(1), F.size(tokens) - len(phrase) + 1)

    def matches(i: Column) -> Column:
        return reduce(
            lambda a, b: a & b, (F.get(tokens, i - 1 + k) == w for k, w in enumerate(phrase))
        )

    return F.when(
        F.size(tokens) >= len(phrase), F.size(F.filter(starts, matches))
    ).otherwise(0)


@dataclass
class TextTable:
    """A searchable table: its key, indexed columns and columns to carry."""

    rows: DataFrame
    key: str
    fields: tuple[str, ...]
    carry: tuple[str, ...] = field(default=())
    stemmed: bool = False
    derived: bool = False  # its rows cost more than writing them and reading them again


def bm25(table: TextTable, phrases: list[list[str]], only: str | None = None) -> DataFrame:
    """Matching rows with their BM25 ``score`` (higher is better).

    ``only`` limits matching to one indexed column; row length still counts
    every indexed column. Carried columns come back with the key.
    """
    if table.stemmed:
        phrases = [[stem(w) for w in p] for p in phrases]
    if not phrases:
        return table.rows.select(table.key, *table.carry, F.lit(0.0).alias("score")).where("false")
    matched_fields = [only] if only else list(table.fields)

    def total(parts: list[Column]) -> Column:
        return reduce(lambda a, b: a + b, parts)

    def measure(tok: Column) -> Column:
        return F.struct(
            total([F.size(tok[f]) for f in table.fields]).alias("_len"),
            *[
                total([phrase_count(tok[f], p) for f in matched_fields]).alias(f"_tf{i}")
                for i, p in enumerate(phrases)
            ],
        )

    def counted(carry: tuple[str, ...]) -> DataFrame:
        # The lambda tokenises a row once; the generator keeps later filters
        # from being pushed below it, which would tokenise the row again.
        words = {f: word_tokens(F.col(f)) for f in table.fields}
        rows = table.rows
        if table.stemmed:
            stems = [stem_tokens(w).alias(f"_stems_{f}") for f, w in words.items()]
            rows = rows.select(table.key, *carry, *stems)
            words = {f: F.col(f"_stems_{f}") for f in table.fields}
        tokens = F.struct(*[w.alias(f) for f, w in words.items()])
        return rows.select(table.key, *carry, F.inline(F.transform(F.array(tokens), measure)))

    stats = counted(()).agg(
        F.struct(
            F.count(F.lit(1)).alias("n"),
            F.avg("_len").alias("avg_len"),
            *[F.count_if(F.col(f"_tf{i}") > 0).alias(f"df{i}") for i in range(len(phrases))],
        ).alias("stats")
    ).scalar()

    hits = counted(table.carry).where(
        reduce(lambda a, b: a | b, (F.col(f"_tf{i}") > 0 for i in range(len(phrases))))
    )
    hits = hits.withColumn("_stats", stats)
    norm = BM25_K1 * (1 - BM25_B + BM25_B * F.col("_len") / F.col("_stats.avg_len"))
    score = F.lit(0.0)
    for i in range(len(phrases)):
        df = F.col(f"_stats.df{i}")
        idf = F.log((F.col("_stats.n") - df + 0.5) / (df + 0.5))
        idf = F.when(idf <= 0, F.lit(BM25_IDF_FLOOR)).otherwise(idf)
        tf = F.col(f"_tf{i}")
        score = score + idf * tf * (BM25_K1 + 1) / (tf + norm)
    return hits.select(table.key, *table.carry, score.alias("score"))


def best(hits: DataFrame, limit: int, *order: Column, rank: str = "rank") -> DataFrame:
    """Top ``limit`` rows by ``order`` with ranks 1..limit.

    The limit runs first (one bounded heap per task), so the unpartitioned
    window only ever numbers ``limit`` rows.
    """
    top = hits.orderBy(*order).limit(limit)
    return top.withColumn(rank, F.row_number().over(Window.orderBy(*order)).cast("bigint"))


def best_per(hits: DataFrame, group: str, limit: int, *order: Column, rank: str = "rank") -> DataFrame:
    """Top rows of every group; pruned map-side before the shuffle."""
    window = Window.partitionBy(group).orderBy(*order)
    return hits.withColumn(rank, F.row_number().over(window).cast("bigint")).where(
        F.col(rank) <= limit
    )
