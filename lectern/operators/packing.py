"""Greedy packing of ordered pieces, folded inside each row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.text import bind


Full = Callable[[Column, Column, Column], Column]


def greedy_starts(sizes: Column, full: Full, gap: int = 0) -> Column:
    """Zero-based positions at which a new group opens.

    ``full(current, size, groups)`` says that the next piece does not fit the
    open group, the last of ``groups``; every piece adds its size plus ``gap``. The accumulator holds only group starts, so the
    fold stays linear in the number of pieces.
    """
    zero = F.lit(0).cast("bigint")
    start = F.struct(
        zero.alias("current"), zero.alias("at"), F.array().cast("array<bigint>").alias("starts"))

    def step(acc: Column, size: Column) -> Column:
        opens = (acc["at"] == 0) | full(acc["current"], size, F.size(acc["starts"]))
        return F.struct(
            (F.when(opens, zero).otherwise(acc["current"]) + size + gap).alias("current"),
            (acc["at"] + 1).alias("at"),
            F.when(opens, F.concat(acc["starts"], F.array(acc["at"]))).otherwise(acc["starts"]).alias("starts"),
        )

    return F.aggregate(sizes, start, step, lambda acc: acc["starts"])


def split_at(pieces: Column, starts: Column) -> Column:
    """Array of groups of pieces, cut at the given positions."""

    def group(start: Column, i: Column) -> Column:
        stop = F.coalesce(F.get(starts, i + 1), F.size(pieces).cast("bigint"))
        return F.slice(pieces, (start + 1).cast("int"), (stop - start).cast("int"))

    return F.transform(starts, group)


def _lengths(pieces: Column) -> Column:
    return F.transform(pieces, lambda p: F.length(p).cast("bigint"))


def packed(pieces: Column, full: Full, gap: int = 0) -> Column:
    return bind(pieces, lambda p: bind(greedy_starts(_lengths(p), full, gap), lambda s: split_at(p, s)))


def chunks(paragraphs: Column, chunk_size: int = 500) -> Column:
    """Chunk texts of one page: about four characters per token."""
    limit = chunk_size * 4
    groups = packed(paragraphs, lambda cur, size, _: cur + size + 1 > limit, gap=2)
    return F.transform(groups, lambda g: F.array_join(g, "\n\n"))


def pages(paragraphs: Column, target: int = 4000) -> Column:
    """Page texts near ``target`` characters.

    Only the first page counts the break after its opening paragraph.
    """
    groups = packed(
        paragraphs, lambda cur, size, n: cur + size + F.when(n == 1, 2).otherwise(0) > target, gap=2)
    return F.transform(groups, lambda g: F.array_join(g, "\n\n"))


def token_batches(tokens: Column, budget: Column) -> Column:
    """Starts of batches whose estimated tokens stay within the budget."""
    return greedy_starts(tokens, lambda cur, size, _: cur + size > budget)


def byte_parts(pieces: Column, limit: int = 45_000) -> Column:
    """Number of parts needed so that each stays within ``limit`` bytes."""
    sizes = F.transform(pieces, lambda p: F.octet_length(p).cast("bigint"))
    return F.size(greedy_starts(sizes, lambda cur, size, _: cur + size > limit)).cast("bigint")
