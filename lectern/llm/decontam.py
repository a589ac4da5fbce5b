"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact edit verification.

Every word position of a document opens a window as long as a benchmark item. A CGK walk reads a window with one
pointer: in step j it puts out the word under the pointer and moves on by bit j of that word's hash, so windows at a
small edit distance become sequences at a small Hamming distance. One repetition has its own hash bits and samples
`SAMPLES` steps, which lie near each other at a random place of the walk; windows that agree with an item in all of them
are candidates. All positions of a batch walk at once, and after each sampled step only those that can still agree walk on.

Items are grouped in classes of lengths up to double the shortest. A class gets as many repetitions as its recall
needs: copies of its items with as many random edits as similarity `SIMILARITY` allows are walked, repetition after
repetition, until `RECALL` of them were candidates. Sampled steps lie within the shortest item of the class, so exact
copies agree in every repetition. The rule is the same for items of any length.

Around a candidate's place the exact word edit distance between the item and the text is computed for every start, the
end floating, for many places at a time: similarity = 1 - distance / words of the item, `SIMILARITY` or more. The best
place per document and item is kept.

Words are runs of word characters, lower-cased, accents composed. Items are handled in blocks of at most `BLOCK_WORDS`
words, so what a task holds is bounded; each block is one pass over the documents.

Defined results: null, empty or short texts give no rows; null items and items without a word are skipped; items with equal words are
reported one by one; repeated rows give repeated results; ties take the first place; very long texts are searched whole. Only doc_id and text (item_id and text) are read, so
other columns can have any name. Empty tables give no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import composed, slices, table

WORD = re.compile(r"\w+")
SIMILARITY, RECALL = 0.8, 0.99
SAMPLES, GAP = 3, 4  # sampled steps of a repetition, and how far one lies after another at most
COPIES = 400  # edited copies that a class's recall is measured on
SLOTS = 1 << 18
BLOCK_WORDS = 2_000_000
AT_ONCE = 1 << 20
STEP = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    return WORD.findall(composed(text).lower())


def hashes_of(words: list[str]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def plan_of(repetition: int, shortest: int) -> tuple[np.uint64, list[int]]:
    """Multiplier that gives a repetition its hash bits, and its sampled steps for items of so many words or more."""
    rng = np.random.default_rng(7_000 + repetition)
    odd, reach = np.uint64(int(rng.integers(1, 2**62)) * 2 + 1), 3 * shortest // 2
    steps = [int(rng.integers(max(2, reach // 4)))]
    for _ in range(SAMPLES - 1):
        steps.append(steps[-1] + int(rng.integers(1, max(1, min(GAP, reach // 4)) + 1)))
    return odd, [min(s, shortest - 1) for s in steps]


class Walk:
    """CGK walks over one array of word hashes with the hash bits of one repetition."""

    def __init__(self, words: np.ndarray, odd: np.uint64) -> None:
        self.words = words
        bits = words * odd
        bits ^= bits >> np.uint64(32)
        self.bytes = bits.view(np.uint8).reshape(-1, 8)

    def moves(self, step: int) -> np.ndarray:
        """For every word, whether a pointer on it moves on in this step."""
        return (self.bytes[:, step >> 3 & 7] >> np.uint8(step & 7)) & np.uint8(1)

    def moved(self, at: np.ndarray, start: int, stop: int) -> np.ndarray:
        """Pointers that stand at `at` in step `start`, in step `stop`."""
        for step in range(start, stop):
            at = np.minimum(at + ((self.bytes[at, step >> 3 & 7] >> np.uint8(step & 7)) & np.uint8(1)), len(self.words) - 1)
        return at

    def reaching(self, wanted: np.ndarray, step: int) -> np.ndarray:
        """Starts whose pointer is on a wanted word in `step`; all starts go back step by step at once."""
        met = wanted.view(np.uint8)
        for j in range(step - 1, -1, -1):
            met[:-1] ^= (met[:-1] ^ met[1:]) & self.moves(j)[:-1]
        return np.flatnonzero(met)


def _slot(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(46)).astype(np.int64)


def _joined(key: np.ndarray, words: np.ndarray) -> np.ndarray:
    key = (key ^ words) * STEP
    return key ^ (key >> np.uint64(29))


def edited(words: np.ndarray, edits: int, rng: np.random.Generator) -> np.ndarray:
    """words with so many random replacements, insertions and deletions."""
    for _ in range(edits):
        kind, place = int(rng.integers(3)), int(rng.integers(len(words)))
        new = rng.integers(1, 2**63, int(kind < 2), dtype=np.uint64)
        words = np.concatenate([words[:place], new, words[place + (kind != 1):]])
    return words


class Items:
    """The items of one block and one class of lengths, with their sampled keys in every repetition."""

    def __init__(self, rows: list[tuple[int, list[str]]], recall: float = RECALL) -> None:
        self.ids = [i for i, _ in rows]
        self.sizes = np.array([len(w) for _, w in rows])
        self.most = ((1 - SIMILARITY) * self.sizes + 1e-9).astype(np.int64)
        self.flat = np.concatenate([hashes_of(w) for _, w in rows])
        self.starts, self.shortest = np.cumsum(self.sizes) - self.sizes, int(self.sizes.min())
        self.tables: list[tuple[list[np.ndarray], np.ndarray, np.ndarray]] = []
        self.marks = np.zeros((len(rows), 256), bool)  # of an item's words, by eight bits of their hashes
        self.marks[np.repeat(np.arange(len(rows)), self.sizes), self.flat & np.uint64(255)] = True
        self._repeat(recall)

    def _keys(self, flat: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Words put out in each sampled step of the next repetition, and keys of the walks up to it."""
        odd, steps = plan_of(len(self.tables), self.shortest)
        walk, key, at = Walk(flat, odd), np.zeros(len(starts), np.uint64), starts
        for before, step in zip([0, *steps], steps):
            at = walk.moved(at, before, step)
            key = _joined(key, flat[at])
            yield flat[at], key

    def _repeat(self, recall: float) -> None:
        """Repetitions until `recall` of edited copies are candidates, at the largest distance that is accepted."""
        rng, parts, places, length = np.random.default_rng(11), [], [], 0
        chosen = np.resize(np.arange(len(self.ids)), COPIES) if len(self.ids) < COPIES else rng.choice(len(self.ids), COPIES, False)
        widest = int(self.most.max())
        for i in chosen.tolist():
            copy = edited(self.words(i), int(self.most[i]), rng)
            around = rng.integers(1, 2**63, widest + 2 * int(self.sizes[i]), dtype=np.uint64)
            parts += [around[:widest], copy, around[widest:]]
            places.append(length + widest)
            length += len(copy) + len(around)
        texts, own = np.concatenate(parts), self.most[chosen][:, None]
        shifts = np.arange(-widest, widest + 1)[None, :]
        windows = np.where(np.abs(shifts) <= own, np.array(places)[:, None] + shifts, np.array(places)[:, None])
        found = np.zeros(len(chosen), bool)
        while found.mean() < recall:
            *_, (_, met) = self._keys(texts, windows.ravel())
            filters: list[np.ndarray] = []
            for words, key in self._keys(self.flat, self.starts):
                used = np.zeros(SLOTS, bool)
                used[_slot(key if filters else words)] = True
                filters.append(used)
            found |= (met.reshape(windows.shape) == key[chosen][:, None]).any(axis=1)
            order = np.argsort(key, kind="stable")
            self.tables.append((filters, key[order], order))

    def found(self, flat: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(start, item) that agree in all sampled steps of a repetition, about AT_ONCE at a time."""
        slots = _slot(flat)
        for repetition, (filters, keys, order) in enumerate(self.tables):
            odd, steps = plan_of(repetition, self.shortest)
            walk = Walk(flat, odd)
            origin = walk.reaching(filters[0][slots], steps[0])
            at = walk.moved(origin, 0, steps[0])
            key = _joined(np.zeros(len(origin), np.uint64), flat[at])
            for before, step, used in zip(steps, steps[1:], filters[1:]):
                at = walk.moved(at, before, step)
                key = _joined(key, flat[at])
                alive = used[_slot(key)]
                at, key, origin = at[alive], key[alive], origin[alive]
            low, high = (np.searchsorted(keys, key, side) for side in ("left", "right"))
            origin, low, counts = origin[high > low], low[high > low], (high - low)[high > low]
            ends, first = np.cumsum(counts), 0
            while first < len(origin):
                before = ends[first - 1] if first else 0
                stop = max(first + 1, int(np.searchsorted(ends, before + AT_ONCE, side="right")))
                part = counts[first:stop]
                entry = np.arange(part.sum()) - np.repeat(np.cumsum(part) - part - low[first:stop], part)
                yield np.repeat(origin[first:stop], part), order[entry]
                first = stop

    def words(self, item: int) -> np.ndarray:
        return self.flat[self.starts[item]:self.starts[item] + self.sizes[item]]


def edit_distance(item: np.ndarray, window: np.ndarray, most: int) -> tuple[int, int]:
    """Least word edit distance between the item and a prefix of the window, and that prefix's length; most + 1 if
    it is larger."""
    n, m = len(item), len(window)
    if m >= n and np.array_equal(item, window[:n]):
        return 0, n
    names = set(item.tolist())
    if sum(w in names for w in window.tolist()) < n - most:
        return most + 1, 0
    width = np.arange(m + 1)
    row = width.astype(np.int64)
    for i in range(n):
        new = np.empty(m + 1, np.int64)
        new[0] = i + 1
        new[1:] = np.minimum(row[1:] + 1, row[:-1] + (window != item[i]))
        row = np.minimum.accumulate(new - width) + width
        if row.min() > most:
            return most + 1, 0
    end = int(row.argmin())
    return int(row[end]), end


def _start_distances(items: np.ndarray, texts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For rows of items and texts: the rows in which the item lies within `most` edits, and for each of them the
    least edit distance from each start in the text (and from its end), whatever the end."""
    width = np.arange(texts.shape[1] + 1, dtype=np.int32)
    rows, texts = np.arange(len(items)), texts[:, ::-1]
    row = np.zeros((len(items), len(width)), np.int32)  # from the item's end to its beginning
    for i in range(items.shape[1]):
        new = np.empty_like(row)
        new[:, 0] = i + 1
        np.minimum(row[:, 1:] + 1, row[:, :-1] + (texts != items[rows, -1 - i][:, None]), out=new[:, 1:])
        row = np.minimum.accumulate(new - width, axis=1) + width
        alive = row.min(axis=1) <= most
        if not alive.all():
            row, rows, texts = row[alive], rows[alive], texts[alive]
            if not len(rows):
                break
    return rows, row[:, ::-1]


def _places(items: Items, flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray,
            item: np.ndarray, doc: np.ndarray, origin: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(doc, item, distance, place) of the places near `origin`, the item's supposed start in flat, the best of each
    row. Rows are distinct; an origin stands for itself and the `most` after it."""
    order = np.argsort(items.sizes[item], kind="stable")
    item, doc, origin = item[order], doc[order], origin[order]
    first = 0
    while first < len(item):
        size, most = int(items.sizes[item[first]]), int(items.most[item[first]])
        length = size + 3 * most
        last = int(np.searchsorted(items.sizes[item], size, side="right"))
        stop = min(last, first + max(1, AT_ONCE // length))
        i, d, begin = item[first:stop], doc[first:stop], origin[first:stop] - most
        first = stop
        place = begin[:, None] + np.arange(length)
        inside = (place >= starts[d][:, None]) & (place < (starts + sizes)[d][:, None])
        texts = np.where(inside, np.take(flat, place, mode="clip"), np.uint64(0))
        # within `most` edits all of the item's other words are in the text
        alike = (items.marks[i[:, None], texts & np.uint64(255)] & inside).sum(axis=1) >= size - most
        i, d, begin, inside, texts = i[alike], d[alike], begin[alike], inside[alike], texts[alike]
        rows, distances = _start_distances(items.flat[items.starts[i][:, None] + np.arange(size)], texts, most)
        if not len(rows):
            continue
        distances = np.where(inside[rows], distances[:, :-1], most + 1)
        at = distances.argmin(axis=1)
        least = distances[np.arange(len(rows)), at]
        good = least <= most
        rows, at, least = rows[good], at[good], least[good]
        yield from zip(d[rows].tolist(), i[rows].tolist(), least.tolist(), (begin[rows] + at).tolist())


Match = tuple[int, int, int, int, int, float]


def matches_in(classes: list[Items], texts: list[str | None]) -> list[Match]:
    """(index of the text, item_id, first word, words, distance, similarity) by text, best place of each item."""
    words = [words_of(t) if t else [] for t in texts]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(sizes) - sizes
    flat = hashes_of([w for own in words for w in own])
    out = []
    for items in classes if len(flat) else ():
        best: dict[tuple[int, int], tuple[int, int]] = {}
        seen: list[np.ndarray] = []
        for place, item in items.found(flat):
            # neighbouring places of a text are checked together
            doc, step = np.searchsorted(starts, place, "right") - 1, items.most[item] + 1
            origin = np.maximum(place // step * step, starts[doc])
            seen.append(np.unique(item * len(flat) + origin))
        if seen:
            item, origin = np.divmod(np.unique(np.concatenate(seen)), len(flat))
            doc = np.searchsorted(starts, origin, "right") - 1
            for d, i, distance, at in _places(items, flat, starts, sizes, item, doc, origin):
                best[d, i] = min(best.get((d, i), (distance, at)), (distance, at))
        for (d, i), (distance, at) in best.items():
            size, most = int(items.sizes[i]), int(items.most[i])
            _, length = edit_distance(items.words(i), flat[at:min(at + size + most, int(starts[d] + sizes[d]))], most)
            out.append((d, items.ids[i], at - int(starts[d]), length, distance, 1 - distance / size))
    return sorted(out, key=lambda m: (m[0], m[1] is None, m[1] or 0))


def item_blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> list[DataFrame]:
    """Items in as many hash blocks as their size asks for; only one sum reaches the driver."""
    rows = benchmark.where("text is not null").select("item_id", "text")
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / (2 * block_words)))
    return [rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b) for b in range(blocks)]


def classes_of(rows: list[tuple[int, list[str]]]) -> list[Items]:
    """Items by classes of lengths, each reaching to double its shortest item; items without words are left out."""
    classes: list[list[tuple[int, list[str]]]] = []
    for row in sorted((r for r in rows if r[1]), key=lambda r: len(r[1])):
        if not classes or len(row[1]) > 2 * len(classes[-1][0][1]):
            classes.append([])
        classes[-1].append(row)
    return list(map(Items, classes))


def items_of(block: DataFrame) -> list[Items]:
    """The items of a block, by class."""
    return classes_of([(r["item_id"], words_of(r["text"])) for r in block.collect()])


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, first_word, n_words, distance, similarity: items found in documents, best place of each."""
    schema = "doc_id long, item_id long, first_word long, n_words long, distance long, similarity double"
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
    parts = []
    for items in filter(None, map(items_of, item_blocks(benchmark))):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in (part for whole in batches for part in slices(whole)):
                columns = list(zip(*matches_in(shared.value, batch.column(1).to_pylist()))) or [[]] * 6
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(columns[0], pa.int64()))]
                    + [pa.array(values, kind) for values, kind in zip(columns[1:], kinds)],
                    ["doc_id", "item_id", "first_word", "n_words", "distance", "similarity"])

        parts.append(docs.select("doc_id", "text").where("text is not null").mapInArrow(run, schema))
    if not parts:
        return docs.sparkSession.createDataFrame([], schema)
    return reduce(DataFrame.union, parts)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, all columns, in which no item is found."""
    place = docs.columns.index("text")
    for items in filter(None, map(items_of, item_blocks(benchmark))):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def keep(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in (part for whole in batches for part in slices(whole, place)):
                hit = {m[0] for m in matches_in(shared.value, batch.column(place).to_pylist())}
                yield batch.filter(pa.array([i not in hit for i in range(batch.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs


def query(spark, sf_dir: str) -> DataFrame:
    """Benchmark items found in documents."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
