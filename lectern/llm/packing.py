"""Packing documents into training sequences along a Hilbert curve.

Every document is tokenised once; its bag of token ids is hashed to a vector, projected to `DIMS` dimensions and
quantised between the corpus-wide bounds of each dimension. The Hilbert key of that cell orders the documents, so
neighbours on the curve use similar tokens. The ordered documents form one stream that is cut every `LENGTH` tokens:
sequence and offset of a piece follow from the number of tokens before its document, so only narrow rows (key, id,
number of tokens) are range-sorted, and the token ids move once. The end of the stream, shorter than a sequence, is
cut into powers of two, so no sequence needs padding.

Defined results: null text is empty; an empty text is one end-of-text token; a null doc_id is packed like any other;
repeated rows are packed each; ties on the curve go by doc_id, then by place in the input. An empty table gives no
rows. Only doc_id and text are read.
"""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import slices, stored, table

LENGTH, END = 2048, 1
DIMS, BITS = 4, 12
HASHED = 1024  # length of the hashed vectors
CACHED_WORDS = 400_000  # of one worker process
_LETTERS = "".join(chr(c) for c in range(0x300) if unicodedata.category(chr(c))[0] == "L")
_NUMBERS = "".join(chr(c) for c in range(0x300) if unicodedata.category(chr(c))[0] == "N")
#: The tokenizer's own split, for texts of the characters below.
WORD = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\s{_LETTERS}{_NUMBERS}]+")
#: Characters for which normalising is plain lower-casing; any other text goes through the library as a whole.
UNUSUAL = re.compile("[^\t\n\r\x20-\x7e\xa0-˿‐-‧‰-⁞€]|<\\|")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_characters() -> list[str]:
    """The characters that byte-level vocabularies write bytes as: printable ones as themselves, the rest from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class Words(dict):
    """Numbers of words in the order they are first asked for, from 1 on; `fresh` lists those without ids yet."""

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        self.fresh.append(word)
        number = self[word] = len(self) + 1
        return number


class Tokens:
    """Token ids of texts. Words that were met keep their ids in one flat array, up to a bound; then it starts anew."""

    def __init__(self, path: str, most: int = CACHED_WORDS) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.bytes, self.most = dict(enumerate(_byte_characters())), most
        self._forget()

    def _forget(self) -> None:
        self.index = Words()
        self.starts, self.sizes = np.zeros(1, np.int64), np.ones(1, np.int64)  # word 0 is the end of a text
        self.flat = np.array([END], np.uint32)

    def _learn(self) -> None:
        model, table_, fresh = self.tokenizer.model, self.bytes, self.index.fresh
        ids = [[t.id for t in model.tokenize(w.encode().decode("latin-1").translate(table_))] for w in fresh]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(ids), np.uint32)])
        self.index.fresh = []

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each followed by END, in one array, and their number per text."""
        split = [None if UNUSUAL.search(t) else WORD.findall(t.lower()) for t in texts]
        if len(self.index) > self.most:
            self._forget()
        index = self.index
        words = np.fromiter(chain.from_iterable(chain(map(index.__getitem__, s or ()), (0,)) for s in split), np.int64)
        if index.fresh:
            self._learn()
        sizes = self.sizes[words]
        ends = np.cumsum(sizes)
        ids = self.flat[np.repeat(self.starts[words] - ends + sizes, sizes) + np.arange(int(ends[-1]))]
        last = np.cumsum([len(s or ()) + 1 for s in split])
        counts = np.diff(ends[last - 1], prepend=0)
        if None not in split:
            return ids, counts
        parts = np.split(ids, np.cumsum(counts)[:-1])
        whole = self.tokenizer.encode_batch_fast([t for t, s in zip(texts, split) if s is None], add_special_tokens=False)
        for i, encoding in zip([i for i, s in enumerate(split) if s is None], whole):
            parts[i] = np.append(np.array(encoding.ids, np.uint32), np.uint32(END))
        return np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))


_TOKENS: dict[str, Tokens] = {}  # of this worker process


def tokens_of(path: str, most: int) -> Tokens:
    if path not in _TOKENS:
        _TOKENS[path] = Tokens(path)
    _TOKENS[path].most = most
    return _TOKENS[path]


def projection(size: int) -> np.ndarray:
    """Row i: what token i adds to the projected vector; hashing to HASHED signed slots and a Gaussian projection."""
    ids = np.arange(size, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    slots, signs = (ids >> np.uint64(40)) % np.uint64(HASHED), 1 - 2 * ((ids >> np.uint64(20)) & np.uint64(1)).astype(np.float32)
    return np.random.default_rng(3).normal(size=(HASHED, DIMS))[slots].astype(np.float32) * signs[:, None]


def hilbert_keys(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places on the Hilbert curve of rows of integer coordinates (Skilling's transpose form, all rows at once)."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            high = (x[i] & q) > 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn = np.where((x[dims - 1] & q) > 0, turn ^ (q - 1), turn)
        q >>= 1
    x ^= turn
    keys = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(dims):
            keys = (keys << 1) | ((x[i] >> bit) & 1)
    return keys


def tokenised(docs: DataFrame, path: str, cached_words: int = CACHED_WORDS) -> DataFrame:
    """row (unique), doc_id, n, x0.. (projected vector), ids (little-endian 16-bit, or 32-bit if the vocabulary asks)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = tokens_of(path, cached_words)
        size = tokens.tokenizer.get_vocab_size(with_added_tokens=True)
        kind, weights = np.uint16 if size <= 1 << 16 else np.uint32, projection(size)
        row = TaskContext.get().partitionId() << 40
        for batch in (part for whole in batches for part in slices(whole)):
            ids, sizes = tokens.of([t or "" for t in batch.column(1).to_pylist()])
            ends = np.cumsum(sizes)
            vectors = np.add.reduceat(weights[ids], ends - sizes) / sizes[:, None]
            narrow = ids.astype(kind)
            blobs = pa.Array.from_buffers(pa.large_binary(), len(sizes), [
                None, pa.py_buffer(np.concatenate(([0], ends * narrow.itemsize)).astype(np.int64)), pa.py_buffer(narrow)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(row, row + len(sizes))), batch.column(0), pa.array(sizes)]
                + [pa.array(vectors[:, d]) for d in range(DIMS)]
                + [blobs.cast(pa.binary()), pa.array(np.full(len(sizes), narrow.itemsize, np.int32))],
                ["row", "doc_id", "n"] + [f"x{d}" for d in range(DIMS)] + ["ids", "id_bytes"])
            row += len(sizes)

    return docs.select("doc_id", "text").mapInArrow(
        run, "row long, doc_id long, n long, " + ", ".join(f"x{d} double" for d in range(DIMS))
        + ", ids binary, id_bytes int")


def _along_the_curve(rows: DataFrame) -> tuple[DataFrame, int]:
    """(row, before: tokens of all documents earlier on the curve), and the number of tokens in all."""
    bounds = rows.agg(*[f(f"x{d}") for d in range(DIMS) for f in (F.min, F.max)]).first()
    low = np.array([b if b is not None else 0.0 for b in bounds[0::2]])
    high = np.array([b if b is not None else 0.0 for b in bounds[1::2]])

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([batch.column(3 + d).to_numpy() for d in range(DIMS)], axis=1)
            cells = np.floor((x - low) / np.where(high > low, high - low, 1) * ((1 << BITS) - 1)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2),
                                              pa.array(hilbert_keys(cells))], ["row", "doc_id", "n", "key"])

    def running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.column(1).to_numpy()
            ends = before + np.cumsum(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ends - n), batch.column(1), pa.array(np.full(len(n), part))],
                ["row", "inside", "n", "part"])
            before = int(ends[-1]) if len(n) else before

    narrow = rows.select("row", "doc_id", "n", *[f"x{d}" for d in range(DIMS)]).mapInArrow(
        keys, "row long, doc_id long, n long, key long")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = stored(narrow.repartitionByRange(parts, "key", "doc_id", "row").sortWithinPartitions("key", "doc_id", "row")
                     .select("row", "n").mapInArrow(running, "row long, inside long, n long, part long"), "curve")
    sums = sorted((r["part"], r["n"]) for r in ordered.groupBy("part").agg(F.sum("n").alias("n")).collect())
    before, starts = 0, []
    for part, n in sums:
        starts.append((part, before))
        before += n
    starts = rows.sparkSession.createDataFrame(starts, "part long, start long")
    # one row per partition of the sort
    return ordered.join(F.broadcast(starts), "part").select("row", (F.col("inside") + F.col("start")).alias("before")), before


def tail_cuts(total: int, length: int = LENGTH) -> list[int]:
    """Ends of the sequences after the last full one: the rest in powers of two, the largest first."""
    place, cuts = total // length * length, []
    for bit in range(length.bit_length() - 1, -1, -1):
        if (total % length) >> bit & 1:
            place += 1 << bit
            cuts.append(place)
    return cuts


def packed(docs: DataFrame, path: str | None = None, length: int = LENGTH, cached_words: int = CACHED_WORDS) -> DataFrame:
    """Pieces: doc_id, start, length, doc_tokens, sequence_id, offset, ids (little-endian unsigned 32-bit).

    cached_words: how many words a worker keeps the ids of; it only trades memory for time.
    """
    path = path or tokenizer_path()
    rows = stored(tokenised(docs, path, cached_words), "tokens")
    places, total = _along_the_curve(rows)
    full = total // length
    ends = np.array(tail_cuts(total, length), np.int64)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 3)):
            out: list[list] = [[] for _ in range(7)]
            for i, (n, blob, width, before) in enumerate(zip(*(batch.column(c).to_pylist() for c in (1, 3, 4, 5)))):
                ids = np.frombuffer(blob, np.uint16 if width == 2 else np.uint32).astype("<u4")
                done = 0
                while done < n:
                    at = before + done
                    if at < full * length:
                        sequence, first, end = at // length, at // length * length, (at // length + 1) * length
                    else:
                        k = int(np.searchsorted(ends, at, "right"))
                        sequence, end = full + k, int(ends[k])
                        first = int(ends[k - 1]) if k else full * length
                    size = min(n - done, end - at)
                    for column, value in zip(out, (i, done, size, n, sequence, at - first, ids[done:done + size].tobytes())):
                        column.append(value)
                    done += size
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(out[0], pa.int64()))] + [pa.array(c, pa.int64()) for c in out[1:6]]
                + [pa.array(out[6], pa.binary())],
                ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

    placed = rows.select("row", "doc_id", "n", "ids", "id_bytes").join(places, "row")
    return placed.select("doc_id", "n", "row", "ids", "id_bytes", "before").mapInArrow(
        cut, "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")


def query(spark, sf_dir: str) -> DataFrame:
    """Every piece of every document with a checksum of its ids."""
    return packed(table(spark, sf_dir, "documents")).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
