"""Words of texts, cut a batch at a time as arrays of bytes: no word is an object of its own.

What a letter or a mark is, is asked of the JVM once, so that words are the same as those of text.word_tokens().
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from lectern.functions.text import ACCENTS, WORD, text_or_empty

SLICE = 4 << 20  # bytes of text that are cut at a time, about
_CLASSES: list[bytes] = []


def char_classes(spark: SparkSession) -> bytes:
    """For each code point 1 if it is part of a word and 2 if it is a mark, as the JVM's expressions see it; compressed."""
    if not _CLASSES:
        one = F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32")
        chars = spark.range(0x110000).where(~F.col("id").between(0xD800, 0xDFFF)).select("id", one.alias("c"))
        kind = F.when(F.col("c").rlike(r"\p{M}"), 2).when(F.col("c").rlike(WORD), 1).otherwise(0)
        found = chars.select(F.col("id").cast("int"), kind.alias("kind")).where("kind > 0").toArrow()
        classes = np.zeros(0x110000, np.uint8)
        classes[found.column("id").to_numpy()] = found.column("kind").to_numpy()
        _CLASSES.append(zlib.compress(classes.tobytes()))
    return _CLASSES[0]


class Cut(NamedTuple):
    """Words of some texts, one text after the other; how many each text has; where they begin in the texts' bytes."""

    words: pa.Array
    per_text: np.ndarray
    begins: np.ndarray
    raw: np.ndarray


def cutter(packed_classes: bytes) -> Callable[[pa.Array], Cut]:
    """Cuts lower-case texts into the words that text.word_tokens() finds."""
    classes = np.frombuffer(zlib.decompress(packed_classes), np.uint8)
    base = np.arange(0x110000, dtype=np.int32)
    for accented, plain in zip(*ACCENTS, strict=True):
        base[ord(accented)] = ord(plain)
    ascii_word = np.zeros(256, bool)
    ascii_word[:128] = classes[:128] == 1

    def cut(texts: pa.Array) -> Cut:
        texts = texts.cast(pa.large_string())
        if len(texts) == 0:
            return Cut(pa.array([], pa.large_string()), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8))
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0]:ends[-1]]
        ends = ends - ends[0]
        word = ascii_word[raw]
        lead = np.flatnonzero(raw >= 0xC0)
        if len(lead):
            padded, raw = np.append(raw, np.zeros(3, np.uint8)), raw.copy()
            size = 2 + (padded[lead] >= 0xE0) + (padded[lead] >= 0xF0)
            first, second, third, fourth = (padded[lead + k].astype(np.int32) & 0x3F for k in range(4))
            code = np.where(size == 2, (first & 0x1F) << 6 | second, np.where(
                size == 3, (first & 0xF) << 12 | second << 6 | third, (first & 7) << 18 | second << 12 | third << 6 | fourth))
            dropped = np.zeros(len(raw), bool)
            plain = base[code]
            bare = np.flatnonzero(plain != code)  # accented letters take two bytes, and so do their bases if not one
            at, to = lead[bare], plain[bare]
            raw[at] = np.where(to < 128, to, 0xC0 | to >> 6)
            raw[at + 1] = 0x80 | to & 0x3F
            dropped[at + 1] = to < 128
            kind = classes[plain]
            for k in range(4):
                more = size > k
                word[lead[more] + k] = kind[more] == 1
                dropped[lead[more] + k] |= kind[more] == 2
            if dropped.any():
                ends = ends - np.searchsorted(np.flatnonzero(dropped), ends)
                raw, word = raw[~dropped], word[~dropped]
        begins, finishes, some = word.copy(), word.copy(), np.diff(ends) > 0
        begins[1:] &= ~word[:-1]
        finishes[:-1] &= ~word[1:]
        for marks, edges in ((begins, ends[:-1][some]), (finishes, ends[1:][some] - 1)):
            marks[edges] = word[edges]  # no word goes on from one text to the next
        begins = np.flatnonzero(begins)
        per_text = np.diff(np.searchsorted(begins, ends))
        offsets = np.append(0, np.cumsum(np.flatnonzero(finishes) + 1 - begins))
        return Cut(pa.LargeStringArray.from_buffers(len(begins), pa.py_buffer(offsets), pa.py_buffer(raw[word])), per_text, begins, raw)

    return cut


def slices(texts: pa.Array, most: int) -> list[tuple[int, int]]:
    """Ranges of texts of about `most` bytes: arrays of a range's bytes and words take some 15 times as much while they are in use."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64))
    cuts = [0, *(np.flatnonzero(np.diff(sizes // most, prepend=0) > 0) + 1).tolist(), len(texts)]
    return [(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if a < b]


def longest_of_lines(c: Column, classes: bytes) -> Column:
    """The first of the longest words of each line that has any, in order."""
    def longest(cut: Cut) -> pa.Array:
        text = np.repeat(np.arange(len(cut.per_text)), cut.per_text)
        line = np.searchsorted(np.flatnonzero((cut.raw == 10) | (cut.raw == 13)), cut.begins)
        size = pc.utf8_length(cut.words).to_numpy()
        opens = np.flatnonzero((np.diff(text, prepend=-1) != 0) | (np.diff(line, prepend=-1) != 0))
        most = np.maximum.reduceat(size, opens) if len(opens) else size
        part = np.repeat(np.arange(len(opens)), np.diff(opens, append=len(size)))
        at = np.flatnonzero(size == most[part])
        at = at[np.diff(part[at], prepend=-1) != 0]
        ends = np.append(0, np.cumsum(np.bincount(text[at], minlength=len(cut.per_text))))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), cut.words.take(pa.array(at)).cast(pa.string()))

    @F.arrow_udf(ArrayType(StringType()))
    def each(texts: pa.Array) -> pa.Array:
        cut = cutter(classes)
        return pa.concat_arrays([longest(cut(texts.slice(a, b - a))) for a, b in slices(texts, SLICE)] or [pa.array([], pa.list_(pa.string()))])

    return each(F.lower(text_or_empty(c)))
