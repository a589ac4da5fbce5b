"""Alignment of two tokenizers' tokens over the same bytes, by lockstep merging.

A text is read as a space and the text. Both tokenizers end a token before every space that follows a character other
than white space (no token of either vocabulary reaches over such a place; `_Side` checks that), so texts are cut
there into chunks, and each distinct chunk that a worker meets is tokenised and merged once. All new chunks of a batch
are merged at once: one NumPy state vector holds the pointers of every chunk into its A and its B tokens. A step
compares the byte ends under the pointers, emits a cut where they agree, advances whichever ends first (both at a cut)
and drops the chunks that are through. A chunk of very many tokens is first split at common ends into lanes of about
`LANE` tokens, so that steps stay few. Tokens between two cuts are a group; every A and B token of a group are linked.

A pair's count is the number of documents that hold it linked. Pairs are counted per block of documents first (a block
is bounded by the pairs of its documents), so only the distinct pairs of a block are shuffled; the totals return to each block and are
looked up there while its documents stream past. No table of pairs is broadcast or collected.

Defined results: null and empty texts, and texts that either tokenizer doesn't give back byte by byte, have no tokens:
zeros and an empty digest. A null doc_id is aligned like any other; repeated rows count as documents of their own; ties
for the highest count all count; very long texts and words are aligned whole. Empty tables give no rows. Only doc_id
and text are read, so other columns can have any name.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import slices, stored, table
from lectern.llm.packing import Words

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
SHIFT = 20  # a pair is a << SHIFT | b
LANE = 4096
CACHED_CHARS = 6_000_000  # of one worker process, counting 24 for a chunk besides its characters
BLOCK_PAIRS = 4_000_000  # distinct pairs of documents, added up over a block of them
LARGE_GROUP = 1 << 16  # links of a group from which its distinct ids are paired instead of its tokens
TOGETHER = 2000  # chunks of one call of a tokenizer
#: How byte_bpe_50k.json splits texts before merging.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CROSSING = re.compile(r"\S ")
UNEVEN = re.compile(r"\s ")
CUT = re.compile(r"(?<=\S)(?= )")


def tokenizer_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(A_FILE), public_tokenizers.path(B_FILE)


def chunks_of(text: str) -> list[str]:
    """The chunks of a space and the text, each without the space it starts with."""
    whole = " " + text
    if UNEVEN.search(whole):
        return [chunk[1:] for chunk in CUT.split(whole)]
    return text.split(" ")


class _Side:
    """Ids of chunks by one tokenizer, and the bytes of each id."""

    def __init__(self, path: str) -> None:
        if path.endswith(".json"):
            self._read_ranks(path)
        else:
            self._read_pieces(path)
        if any(CROSSING.search(b.decode(errors="ignore")) for b in self.bytes):
            raise ValueError(f"{path}: a token goes on after a space that follows another character")
        self.sizes = np.fromiter(map(len, self.bytes), np.int64, len(self.bytes))

    def _read_ranks(self, path: str) -> None:
        """Byte-level BPE: ids are in merge order, so that they serve as ranks; special strings are plain text."""
        from tiktoken import Encoding

        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        special = {token["id"] for token in described["added_tokens"]}
        printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
        others = iter(range(256, 512))
        byte_of = {chr(b if b in printable else next(others)): b for b in range(256)}
        names = {i: bytes(map(byte_of.__getitem__, name)) for name, i in described["model"]["vocab"].items() if i not in special}
        self.bytes = [names.get(i, b"") for i in range(max([*names, *special]) + 1)]
        library = Encoding("ranks", pat_str=SPLIT, mergeable_ranks={b: i for i, b in names.items()}, special_tokens={})
        self.whole = lambda chunk: library.encode_ordinary(" " + chunk)

    def _read_pieces(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        library = SentencePieceProcessor(model_file=path)
        pieces = [library.id_to_piece(i) for i in range(library.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if library.is_byte(i) else p.replace("▁", " ").encode()
                      for i, p in enumerate(pieces)]
        space = [library.piece_to_id("▁")]
        # the library puts a space before what it is given, but not before nothing
        self.whole = lambda chunk: library.encode(chunk, num_threads=1) if chunk else space

    def ids(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks, and their number per chunk; none for a chunk that they don't give back.

        As texts may be cut between chunks, chunks are also put together: one call takes many."""
        raw = [b" " + c.encode() for c in chunks]
        ids = np.array(self.whole(" ".join(chunks)), np.int64)
        if b"".join(map(self.bytes.__getitem__, ids.tolist())) == b"".join(raw):
            ends = np.searchsorted(np.cumsum(self.sizes[ids]), np.cumsum([len(r) for r in raw])) + 1
            return ids, np.diff(ends, prepend=0)
        if len(chunks) == 1:
            return ids[:0], np.zeros(1, np.int64)
        parts = [self.ids([c]) for c in chunks]
        return tuple(np.concatenate(p) for p in zip(*parts))


def _split_lanes(ends_a: np.ndarray, ends_b: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Places (tokens before it in A, in B) where both end, about every `most` tokens of A, and the end."""
    places = []
    for k in range(most, len(ends_a), most):
        window = ends_a[k:k + 256]
        at = np.minimum(np.searchsorted(ends_b, window), len(ends_b) - 1)
        same = np.flatnonzero(ends_b[at] == window)
        if len(same) and (not places or k + same[0] + 1 > places[-1][0]):
            places.append((k + int(same[0]) + 1, int(at[same[0]]) + 1))
    if not places or places[-1][0] < len(ends_a):
        places.append((len(ends_a), len(ends_b)))
    return places


def lockstep(ends_a: np.ndarray, counts_a: np.ndarray, ends_b: np.ndarray, counts_b: np.ndarray,
             most: int = LANE) -> tuple[np.ndarray, np.ndarray]:
    """Cuts of many texts at once, as the numbers of A and of B tokens before each in the flat arrays.

    ends_a and ends_b hold the byte ends of the tokens, text after text, from 0 in each; counts are tokens per text.
    Both sides of a text end at the same byte and hold a token at least.
    """
    i, j = np.cumsum(counts_a) - counts_a, np.cumsum(counts_b) - counts_b
    last = i + counts_a
    for lane in np.flatnonzero(counts_a > most).tolist():
        a, b = int(i[lane]), int(j[lane])
        places = _split_lanes(ends_a[a:a + counts_a[lane]], ends_b[b:b + counts_b[lane]], most)
        last[lane] = a + places[0][0]
        i = np.concatenate([i, [a + p for p, _ in places[:-1]]]).astype(np.int64)
        j = np.concatenate([j, [b + q for _, q in places[:-1]]]).astype(np.int64)
        last = np.concatenate([last, [a + p for p, _ in places[1:]]]).astype(np.int64)
    cuts_a, cuts_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while len(i):
        x, y = ends_a[i], ends_b[j]
        i, j = i + (x <= y), j + (y <= x)
        met = x == y
        cuts_a.append(i[met])
        cuts_b.append(j[met])
        running = i < last
        if not running.all():
            i, j, last = i[running], j[running], last[running]
    return np.sort(np.concatenate(cuts_a)), np.sort(np.concatenate(cuts_b))


def _linked_pairs(a: np.ndarray, b: np.ndarray, cuts_a: np.ndarray, cuts_b: np.ndarray, owner: np.ndarray
                  ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """owner, pair and number of links of the id pairs of all groups; an owner's pair may come several times."""
    first_a, first_b = np.concatenate([[0], cuts_a[:-1]]), np.concatenate([[0], cuts_b[:-1]])
    wide = cuts_b - first_b
    links = (cuts_a - first_a) * wide
    small = np.flatnonzero(links <= LARGE_GROUP)
    group = np.repeat(small, links[small])
    inner = np.arange(len(group)) - np.repeat(np.cumsum(links[small]) - links[small], links[small])
    pairs = [a[first_a[group] + inner // wide[group]] << SHIFT | b[first_b[group] + inner % wide[group]]]
    owners, times = [owner[group]], [np.ones(len(group), np.int64)]
    for g in np.flatnonzero(links > LARGE_GROUP).tolist():
        names_a, times_a = np.unique(a[first_a[g]:cuts_a[g]], return_counts=True)
        names_b, times_b = np.unique(b[first_b[g]:cuts_b[g]], return_counts=True)
        pairs.append((names_a[:, None] << SHIFT | names_b[None, :]).ravel())
        times.append((times_a[:, None] * times_b[None, :]).ravel())
        owners.append(np.full(len(pairs[-1]), owner[g]))
    return np.concatenate(owners), np.concatenate(pairs), np.concatenate(times)


def _summed(owners: np.ndarray, pairs: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same with every owner's pair once, by owner and pair."""
    key = owners << 2 * SHIFT | pairs
    order = np.argsort(key, kind="stable")
    key = key[order]
    fresh = np.flatnonzero(np.diff(key, prepend=-1))
    total = np.add.reduceat(times[order], fresh) if len(fresh) else times[:0]
    return key[fresh] >> 2 * SHIFT, key[fresh] & (1 << 2 * SHIFT) - 1, total


class Aligner:
    """Aligned chunks of a worker process. Chunk 0 stands for no chunk."""

    def __init__(self, path_a: str, path_b: str) -> None:
        self.a, self.b = _Side(path_a), _Side(path_b)
        names = [[str(i).encode() for i in range(len(side.bytes))] for side in (self.a, self.b)]
        #: text of an id and what follows it: inside its side of a group, at that side's end
        self.texts = [n + end for side, ends in zip(names, (b",|", b",;")) for end in (ends[:1], ends[1:]) for n in side]
        self._forget()

    def _forget(self) -> None:
        self.index, self.weight = Words(), 0
        self.known, self.groups = np.ones(1, bool), [b""]
        self.counts = np.zeros((4, 1), np.int64)  # A tokens, B tokens, groups, links
        self.starts, self.sizes = np.zeros(1, np.int64), np.zeros(1, np.int64)  # of a chunk's pairs
        self.pairs, self.times = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self) -> None:
        fresh, self.index.fresh = self.index.fresh, []
        self.weight += sum(map(len, fresh)) + 24 * len(fresh)
        # a chunk that ends in white space, or is nothing but a space, ends its text: it is tokenised alone
        alone = [not c or c[-1].isspace() for c in fresh]
        order = np.argsort(alone, kind="stable")
        fresh = [fresh[k] for k in order.tolist()]
        joined = len(fresh) - sum(alone)
        calls = [fresh[k:min(k + TOGETHER, joined)] for k in range(0, joined, TOGETHER)] + [[c] for c in fresh[joined:]]
        (a, counts_a), (b, counts_b) = (
            tuple(np.concatenate(p) for p in zip(*map(side.ids, calls))) for side in (self.a, self.b))
        known = (counts_a > 0) & (counts_b > 0)
        a, b = a[np.repeat(known, counts_a)], b[np.repeat(known, counts_b)]
        counts_a, counts_b = counts_a * known, counts_b * known
        at, back = np.flatnonzero(known), np.argsort(order)

        def ends(side: _Side, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
            total = np.cumsum(side.sizes[ids])
            before = np.concatenate([[0], total])[np.cumsum(counts) - counts]
            return total - np.repeat(before, counts)

        cuts_a, cuts_b = lockstep(ends(self.a, a, counts_a), counts_a[at], ends(self.b, b, counts_b), counts_b[at])
        owner = np.repeat(np.arange(len(fresh)), counts_a)[cuts_a - 1] if len(cuts_a) else np.zeros(0, np.int64)
        owners, pairs, times = _summed(*_linked_pairs(a, b, cuts_a, cuts_b, owner)) if len(cuts_a) else (owner,) * 3
        sizes = np.bincount(owners, minlength=len(fresh))
        self.starts = np.concatenate([self.starts, (len(self.pairs) + np.cumsum(sizes) - sizes)[back]])
        self.sizes = np.concatenate([self.sizes, sizes[back]])
        self.pairs, self.times = np.concatenate([self.pairs, pairs]), np.concatenate([self.times, times])
        links = np.bincount(owners, weights=times, minlength=len(fresh)).astype(np.int64)
        groups = np.bincount(owner, minlength=len(fresh))
        self.counts = np.concatenate([self.counts, np.stack([counts_a, counts_b, groups, links])[:, back]], axis=1)
        self.known = np.concatenate([self.known, known[back]])
        written = self._written(a, b, cuts_a, cuts_b, counts_a + counts_b)
        self.groups.extend(map(written.__getitem__, back.tolist()))

    def _written(self, a: np.ndarray, b: np.ndarray, cuts_a: np.ndarray, cuts_b: np.ndarray, counts: np.ndarray
                 ) -> list[bytes]:
        """Texts of the groups of new chunks: A ids, |, B ids and ; of each group."""
        size_a, size_b = len(self.a.bytes), len(self.b.bytes)
        at_a, at_b = a.copy(), b + 2 * size_a
        at_a[cuts_a - 1] += size_a
        at_b[cuts_b - 1] += size_b
        group_a = np.repeat(np.arange(len(cuts_a)), np.diff(cuts_a, prepend=0))
        group_b = np.repeat(np.arange(len(cuts_b)), np.diff(cuts_b, prepend=0))
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + np.concatenate([[0], cuts_b])[group_a]] = at_a
        order[np.arange(len(b)) + cuts_a[group_b]] = at_b
        parts = list(map(self.texts.__getitem__, order.tolist()))
        ends = np.cumsum(counts).tolist()
        return [b"".join(parts[start:end]) for start, end in zip([0, *ends], ends)]

    def of(self, texts: list[str | None]) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray, np.ndarray]:
        """Counts (rows of A tokens, B tokens, groups, links), group texts, and per text the number of its distinct
        pairs, these, and their links."""
        if self.weight > CACHED_CHARS:
            self._forget()
        split = [chunks_of(t) if t else [] for t in texts]
        index = self.index
        chunks = np.fromiter(chain.from_iterable(chain(map(index.__getitem__, s), (0,)) for s in split), np.int64)
        if index.fresh:
            self._learn()
        lengths = np.fromiter((len(s) + 1 for s in split), np.int64, len(split))
        row, first = np.repeat(np.arange(len(split)), lengths), np.cumsum(lengths) - lengths
        whole = np.logical_and.reduceat(self.known[chunks], first)
        chunks = np.where(whole[row], chunks, 0)
        counts = np.add.reduceat(self.counts[:, chunks], first, axis=1)
        groups = [b"".join(map(self.groups.__getitem__, chunks[f:f + n].tolist()))[:-1] for f, n in
                  zip(first.tolist(), lengths.tolist())]
        rows, names, times = _summed(row, chunks, np.ones(len(chunks), np.int64))
        sizes = self.sizes[names]
        ends = np.cumsum(sizes)
        at = np.repeat(self.starts[names] - ends + sizes, sizes) + np.arange(int(ends[-1]))
        rows, pairs, times = _summed(np.repeat(rows, sizes), self.pairs[at], self.times[at] * np.repeat(times, sizes))
        return counts, groups, np.bincount(rows, minlength=len(split)), pairs, times


_ALIGNERS: dict[tuple[str, str], Aligner] = {}  # of this worker process


def _lists(sizes: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values))


def _aligner(paths: tuple[str, str]) -> Aligner:
    if paths not in _ALIGNERS:
        _ALIGNERS[paths] = Aligner(*paths)
    return _ALIGNERS[paths]


COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def aligned(docs: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links and `groups`, the A and B ids of each group in order: a1,a2|b1;a3|b2,b3."""
    paths = paths or tokenizer_paths()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            counts, groups, *_ = _aligner(paths).of(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *map(pa.array, counts), pa.array([g.decode() for g in groups], pa.string())],
                ["doc_id", *COUNTS, "groups"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        rows, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", groups string")


def _digests(docs: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """aligned() with a digest for the groups, the row's distinct pairs with their links, and its block."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = TaskContext.get().partitionId() << 24, 0
        for batch in (part for whole in batches for part in slices(whole)):
            counts, groups, sizes, pairs, times = _aligner(paths).of(batch.column(1).to_pylist())
            digests = [hashlib.sha256(g).hexdigest() if g else "" for g in groups]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *map(pa.array, counts), pa.array(digests), _lists(sizes, pairs), _lists(sizes, times),
                 pa.array(np.full(len(digests), block))],
                ["doc_id", *COUNTS, "groups_sha256", "pairs", "times", "block"])
            held += len(pairs)
            if held > BLOCK_PAIRS:
                block, held = block + 1, 0

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        rows, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS)
        + ", groups_sha256 string, pairs array<long>, times array<long>, block long")


def pair_counts(in_blocks: DataFrame) -> DataFrame:
    """(block, pair, docs) -> pair, count, best: documents that hold the pair, and whether that is its A id's most."""
    total = in_blocks.groupBy("pair").agg(F.sum("docs").alias("count")).withColumn("a", F.shiftright("pair", SHIFT))
    most = total.groupBy("a").agg(F.max("count").alias("most"))
    return total.join(most, "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def _looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by block, in each the counts of its pairs before its documents."""
    held: list[tuple[np.ndarray, ...]] = []
    names = counts = best = np.zeros(0, np.int64)
    at = None
    for batch in batches:
        blocks, lookup = batch["block"].to_numpy(), batch["pair"].is_valid().to_numpy(zero_copy_only=False)
        turns = np.flatnonzero((np.diff(blocks) != 0) | (np.diff(lookup.astype(np.int8)) != 0)) + 1
        for start, stop in zip([0, *turns.tolist()], [*turns.tolist(), batch.num_rows]):
            part = batch.slice(start, stop - start)
            if not part.num_rows:
                continue
            if at != blocks[start]:
                at, held = blocks[start], []
                names = counts = best = np.zeros(0, np.int64)
            if lookup[start]:
                held.append(tuple(part[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("pair", "count", "best")))
                continue
            if held:
                names, counts, best = (np.concatenate(c) for c in zip(*held))
                order = np.argsort(names)
                names, counts, best, held = names[order], counts[order], best[order], []
            pairs, times = part["pairs"].flatten().to_numpy(), part["times"].flatten().to_numpy()
            row = np.repeat(np.arange(part.num_rows), part["pairs"].value_lengths().to_numpy())
            place = np.searchsorted(names, pairs)
            sums = []
            for value in (best, counts):
                out = np.zeros(part.num_rows, np.int64)
                np.add.at(out, row, value[place] * times)
                sums.append(pa.array(out))
            kept = ["doc_id", *COUNTS]
            yield pa.RecordBatch.from_arrays([*(part[c] for c in kept), *sums, part["groups_sha256"]],
                                             [*kept, "n_best", "count_sum", "groups_sha256"])


def with_counts(docs: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row."""
    rows = stored(_digests(docs, paths or tokenizer_paths()), "alignments")
    in_blocks = stored(rows.select("block", F.explode("pairs").alias("pair")).groupBy("block", "pair").agg(
        F.count("*").alias("docs")), "pairs")
    lookup = in_blocks.join(pair_counts(in_blocks), "pair").select("block", "pair", "count", "best")
    # as many partitions as blocks, so that they don't grow with the input
    blocks = max(1, rows.select("block").distinct().count())
    both = lookup.unionByName(rows, allowMissingColumns=True).repartition(blocks, "block").sortWithinPartitions(
        "block", F.col("pair").isNull())
    return both.mapInArrow(_looked_up, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS)
                           + ", n_best long, count_sum long, groups_sha256 string")


def query(spark, sf_dir: str) -> DataFrame:
    """Every document with its numbers of tokens, groups and links, their corpus-wide counts, and a digest."""
    return with_counts(table(spark, sf_dir, "documents"))
