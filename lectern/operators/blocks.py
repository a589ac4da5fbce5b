"""Postings of large tables, packed: one row holds the postings that all terms of a bucket have in some rows of the table.

Texts reach Python as they are, in lower case; they are cut into words, and the words grouped by term, as whole arrays,
so that no word and no posting is an object or a row of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from lectern.functions.stem import stem
from lectern.functions.words import cutter

FIELD = 1 << 40  # a place is the column's number times this, plus the word's position
TASK_ROWS = 1 << 33  # a row's number is its task's number times this, plus its number in the task
GROUP_TEXT = 4 << 20  # bytes of text whose words are grouped at a time, about; the arrays for it take some 25 times as much
STEP = 1 << 20  # numbers that are unpacked at a time, about
LAST = -1 << 31  # marks the last place of a posting
ROWS = -1  # bucket of the table's rows
#: A bucket's terms in some rows, one a line; where the postings of each end; the postings as 32-bit numbers: the row's
#: number in its task, then its places. A place is the word's position times the number of columns, plus the column's number.
BLOCK = [StructField("bucket", IntegerType()), StructField("task", LongType()), *[StructField(c, BinaryType()) for c in ("terms", "ends", "postings")]]
UNPACKED = "term string, `_row` bigint, places array<bigint>"


def _lines(terms: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The terms, a line each, and where the lines end."""
    lined = pc.binary_join_element_wise(terms.cast(pa.large_string()), *(pa.scalar(c, pa.large_string()) for c in ("", "\n")))
    ends = np.frombuffer(lined.buffers()[1], np.int64)[lined.offset:lined.offset + len(lined) + 1]
    return np.frombuffer(lined.buffers()[2], np.uint8)[ends[0]:ends[-1]], ends - ends[0]


def bucket(terms: pa.Array, buckets: int) -> np.ndarray:
    """Each term's bucket, from its bytes."""
    if len(terms) == 0:
        return np.zeros(0, np.int32)
    raw, ends = _lines(terms)
    size = np.diff(ends)
    powers = np.multiply.accumulate(np.full(size.max(), 0x100000001B3, np.uint64))
    mixed = np.add.reduceat(raw * powers[np.arange(len(raw)) - np.repeat(ends[:-1], size)], ends[:-1])
    return ((mixed ^ mixed >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)


def packed_schema(row: StructType) -> StructType:
    return StructType([*BLOCK, StructField("row", StructType([StructField("_number", IntegerType()), StructField("_len", LongType()), *row.fields]))])


def _order(*keys: np.ndarray) -> np.ndarray:
    """Order by the last key, then the one before it, and so on; 16 bits at a time, which is a radix sort."""
    order = np.arange(len(keys[0]))
    for key in keys:
        for shift in (0, 16):
            part = (key >> shift).astype(np.uint16)
            if part.any():
                order = order[np.argsort(part[order], kind="stable")]
    return order


def _blocks(words: list[pa.Array], per_text: list[np.ndarray], numbers: np.ndarray, task: int, stemmed: bool, buckets: int) -> list[pa.Array]:
    """Columns of BLOCK: the words grouped by bucket and term, and by row and place within it."""
    fields = len(words)
    row = np.concatenate([np.repeat(np.arange(len(n), dtype=np.int32), n) for n in per_text])
    place = np.concatenate([(np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * fields + k for k, n in enumerate(per_text)])
    if len(place) and place.max() >= 1 << 31:
        raise OverflowError("a text has too many words for its index")
    coded = pa.concat_arrays(words).dictionary_encode()
    code, terms = coded.indices.to_numpy(), coded.dictionary
    if stemmed:  # each distinct word once
        stems = pa.array([stem(w) for w in terms.to_pylist()], pa.string()).dictionary_encode()
        code, terms = stems.indices.to_numpy()[code], stems.dictionary
    if len(code) == 0:
        return [pa.nulls(0, t) for t in (pa.int32(), pa.int64(), *[pa.binary()] * 3)]
    own = bucket(terms, buckets)
    by_bucket = np.argsort(own, kind="stable")
    spot = np.empty(len(terms), np.int32)
    spot[by_bucket] = np.arange(len(terms))
    code, own = spot[code], own[by_bucket]
    order = _order(*([row] if fields > 1 else []), code)  # rows are in order within a field, and words within a row
    place, code, row = place[order].astype(np.int32), code[order], row[order]
    other = np.diff(code, prepend=-1) != 0
    opens = other | (np.diff(row, prepend=-1) != 0)
    first = np.flatnonzero(opens)
    at = np.arange(len(order)) + np.cumsum(opens)  # each posting has its row's number before its places
    stream = np.empty(len(order) + len(first), np.int32)
    stream[at] = place
    stream[at[first] - 1] = numbers[row[first]]
    stream[at[np.append(first[1:], len(order)) - 1]] |= LAST
    begins = np.append(at[np.flatnonzero(other)] - 1, len(stream))  # of each term
    cuts = np.append(np.flatnonzero(np.diff(own, prepend=-1)), len(own))  # the terms of each bucket
    parts = list(zip(cuts[:-1], cuts[1:], strict=True))
    lines, ends = _lines(terms.take(pa.array(by_bucket)))
    return [
        pa.array(own[cuts[:-1]]), pa.array(np.full(len(parts), task, np.int64)),
        pa.array([lines[ends[a]:ends[b]].tobytes() for a, b in parts], pa.binary()),
        pa.array([(begins[a + 1:b + 1] - begins[a]).astype(np.int32).tobytes() for a, b in parts], pa.binary()),
        pa.array([stream[begins[a]:begins[b]].tobytes() for a, b in parts], pa.binary())]


def packer(fields: int, stemmed: bool, buckets: int, classes: bytes) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks of the rows (key, row, lower-case texts), and the rows themselves in a bucket of their own, with their number
    and length. A key has one number in a task, however many rows it has."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, task, known = cutter(classes), TaskContext.get().partitionId(), {}

        def grouped(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            numbers = np.array([known.setdefault(k, len(known)) for k in whole.column(0).to_pylist()], np.int32)
            cuts = [cut(whole.column(2 + k)) for k in range(fields)]
            lengths, shown = np.sum([c.per_text for c in cuts], axis=0), whole.column(1)
            blocks = _blocks([c.words for c in cuts], [c.per_text for c in cuts], numbers, task, stemmed, buckets)
            names = ["_number", "_len", *(shown.type.field(i).name for i in range(shown.type.num_fields))]
            shown = pa.StructArray.from_arrays([pa.array(numbers), pa.array(lengths), *shown.flatten()], names)
            n, m = len(blocks[0]), len(shown)
            rows = [pa.array(np.full(m, ROWS, np.int32)), pa.array(np.full(m, task, np.int64)), *[pa.nulls(m, pa.binary())] * 3]
            columns = [pa.concat_arrays(both) for both in zip(blocks, rows, strict=True)]
            return pa.RecordBatch.from_arrays([*columns, pa.concat_arrays([pa.nulls(n, shown.type), shown])], [*(f.name for f in BLOCK), "row"])

        held, size = [], 0
        for batch in batches:
            begin, sizes = 0, np.cumsum(sum(pc.binary_length(batch.column(2 + k)).to_numpy().astype(np.int64) for k in range(fields)))
            for end in np.flatnonzero(np.diff((sizes + size) // GROUP_TEXT, prepend=size // GROUP_TEXT) > 0) + 1:
                held.append(batch.slice(begin, int(end) - begin))
                yield grouped(held)
                held, begin = [], int(end)
            if begin < batch.num_rows:
                held.append(batch.slice(begin))
            size += int(sizes[-1]) if len(sizes) else 0
        if held:
            yield grouped(held)

    return run


def unpacker(fields: int, wanted: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(term, row's number, places) of each posting that the wanted terms have in some blocks."""
    def unpacked(term: str, task: int, stream: np.ndarray) -> Iterator[pa.RecordBatch]:
        last = np.flatnonzero(stream < 0)
        first = np.append(0, last[:-1] + 1)
        cuts = np.unique(np.append(np.searchsorted(first, np.arange(0, len(stream), STEP)), len(first)))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            begin, some = first[a], stream[first[a]:last[b - 1] + 1]
            kept = np.ones(len(some), bool)
            kept[first[a:b] - begin] = False
            places = some[kept] & ~LAST
            places = places // fields + (places % fields).astype(np.int64) * FIELD
            ends = np.append(0, np.cumsum(last[a:b] - first[a:b]))
            yield pa.RecordBatch.from_arrays([
                pa.array([term]).take(pa.array(np.zeros(b - a, np.int64))), pa.array(some[first[a:b] - begin] + np.int64(task * TASK_ROWS)),
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(places))], ["term", "_row", "places"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                task, terms, ends, stream = (batch.column(c)[i] for c in ("task", "terms", "ends", "postings"))
                lines, ends = b"\n" + terms.as_py(), np.frombuffer(ends.as_buffer(), np.int32)
                stream = np.frombuffer(stream.as_buffer(), np.int32)
                for term in wanted:
                    at = lines.find(b"\n" + term.encode() + b"\n")
                    if at >= 0:
                        k = lines.count(b"\n", 0, at)
                        yield from unpacked(term, task.as_py(), stream[ends[k - 1] if k else 0:ends[k]])

    return run
