"""Near duplicates by Order MinHash with verification by banded alignment.

Words are runs of word characters, lower-cased. A text's k-mers are its shingles of five words, each labelled with
its occurrence number (a text under five words is one shingle). A sketch takes the `LENGTH` k-mers that are smallest
under one hash function, in text order; two texts are candidates if they share one of `SKETCHES` sketches. At a
similarity of 0.8 a pair of long texts is missed with a chance of about 0.0002, one of short texts more often (8 of 10
shingles: 0.0015). Texts of `FEW` shingles or less are candidates also if they become equal by leaving out one shingle
or none in each, which all pairs of them with a similarity of 0.8 do: none is missed. Candidates are verified by aligning their shingle
sequences inside the band that a similarity of 0.8 leaves: similarity = aligned / (n1 + n2 - aligned).

Exact copies collapse first, so everything after works on distinct texts. A bucket of at most `SMALL` texts compares
its texts with each other. A larger one first compares its members with its smallest id. What is then not in the
bucket's largest class is compared, in blocks, with all of its other classes, whatever the bucket's size: one shared
sketch makes a candidate in every bucket. Before, members and pairs go that cannot reach 0.8 because too many of their
k-mers are in no other member of such a bucket; k-mers are counted for these buckets only, and within a task before
they are shuffled. Classes are connected components.

Defined results: null text is its own class; texts without any word are copies only if identical; a null doc_id gets
a null class and takes no part; repeated rows and rows sharing an id share a class. Ties cannot matter: the class id
is the smallest doc_id. Empty tables give no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import composed, slices, stored, table
from lectern.llm.components import components

SHINGLE, SIMILARITY = 5, 0.8
LENGTH, SKETCHES = 4, 16
FEW = 9  # two texts of at most 9 shingles reach 0.8 only if each has at most one that is not aligned
SMALL = 32
BLOCK, TEXT = 100_000, 200  # k-mers of a block of texts that are compared with another's; a text counts as so many more
WORD = re.compile(r"\w+")
SEEDS = np.random.default_rng(20240501).integers(1, 2**63, SKETCHES, dtype=np.uint64)
STEP, TURN = np.uint64(0xBF58476D1CE4E5B9), np.uint64(31)
COPIES_KEPT = 20_000
LONG = 20_000


def mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(30))) * STEP
    return values ^ (values >> TURN)


def words_of(text: str) -> list[str]:
    return WORD.findall(composed(text).lower())


def word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh32_intdigest, words), np.uint32, len(words))


def shingles(hashes: np.ndarray) -> np.ndarray:
    """64-bit hashes of the windows of five words; of all words if there are fewer."""
    width = min(SHINGLE, len(hashes))
    wide = hashes.astype(np.uint64)
    out = np.zeros(len(wide) - width + 1, np.uint64)
    for j in range(width):
        out = mixed(out + wide[j:len(wide) - width + 1 + j] + np.uint64(j + 1))
    return out


def labelled(kmers: np.ndarray) -> np.ndarray:
    """k-mers made distinct by their occurrence number."""
    order = np.argsort(kmers, kind="stable")
    ranked = kmers[order]
    fresh = np.concatenate(([True], ranked[1:] != ranked[:-1]))
    if fresh.all():
        return kmers
    first = np.maximum.accumulate(np.where(fresh, np.arange(len(ranked)), 0))
    occurrence = np.empty(len(kmers), np.uint64)
    occurrence[order] = (np.arange(len(ranked)) - first).astype(np.uint64)
    return mixed(kmers + occurrence * np.uint64(0x9E3779B97F4A7C15))


def sketches(kmers: np.ndarray) -> np.ndarray:
    """One 64-bit key per hash function: its smallest labelled k-mers, combined in text order."""
    marked = labelled(kmers)
    size = min(LENGTH, len(marked))
    if len(marked) <= LONG:
        hashed = mixed(marked[None, :] ^ SEEDS[:, None])
        at = np.argpartition(hashed, size - 1, axis=1)[:, :size] if size < len(marked) else np.tile(
            np.arange(size), (SKETCHES, 1))
    else:
        at = np.stack([np.argpartition(mixed(marked ^ seed), size - 1)[:size] for seed in SEEDS])
    chosen = marked[np.sort(at, axis=1)]
    keys = np.zeros(SKETCHES, np.uint64)
    for j in range(size):
        keys = mixed(keys + chosen[:, j] + np.uint64(j + 1))
    return keys.view(np.int64)


def shortened(kmers: np.ndarray) -> np.ndarray:
    """Keys of a text of few shingles and of what is left of it without each one of them; none for longer texts and
    those too short to spare one, whose sketch is the whole text."""
    if not LENGTH <= len(kmers) <= FEW:
        return np.zeros(0, np.int64)
    left = [kmers, *(np.delete(kmers, i) for i in range(len(kmers)))]
    return np.unique(np.array([xxhash.xxh3_64_intdigest(k.tobytes()) for k in left], np.uint64).view(np.int64))


def _sketch_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    met: dict[bytes, tuple[int, np.ndarray | None]] = {}
    for batch in (part for whole in batches for part in slices(whole)):
        exact, sizes, keys = [], [], []
        for text in batch.column(1).to_pylist():
            if text is None:
                exact.append(None), sizes.append(0), keys.append(None)
                continue
            words = words_of(text)
            mark = xxhash.xxh3_128_digest("w " + " ".join(words) if words else "t " + text)
            if mark not in met:
                if len(met) > COPIES_KEPT:
                    met.clear()
                if words:
                    kmers = shingles(word_hashes(words))
                    met[mark] = len(kmers), np.concatenate([sketches(kmers), shortened(kmers)])
                else:
                    met[mark] = 0, None
            exact.append(mark), sizes.append(met[mark][0]), keys.append(met[mark][1])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(exact, pa.binary()), pa.array(sizes, pa.int64()),
             pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "exact", "n", "keys"])


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in slices(whole)):
        blobs = [word_hashes(words_of(t)).tobytes() for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(blobs, pa.binary())], ["doc_id", "words"])


def _aligned(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Longest common subsequence of a and b among the positions at most `band` apart."""
    both = min(len(a), len(b))
    differ = np.flatnonzero(a[:both] != b[:both])
    head = int(differ[0]) if len(differ) else both
    a, b = a[head:], b[head:]
    both = min(len(a), len(b))
    differ = np.flatnonzero(a[len(a) - both:][::-1] != b[len(b) - both:][::-1])
    tail = int(differ[0]) if len(differ) else both
    a, b = a[:len(a) - tail], b[:len(b) - tail]
    if not len(a) or not len(b):
        return head + tail
    names, counts = np.unique(b, return_counts=True)
    at = np.minimum(np.searchsorted(names, a), len(names) - 1)
    if counts[at][names[at] == a].sum() <= 8 * (len(a) + len(b)):
        places: dict[int, list[int]] = {}
        for j, value in enumerate(b.tolist()):
            places.setdefault(value, []).append(j)
        ends: list[int] = []
        for i, value in enumerate(a.tolist()):
            for j in reversed(places.get(value, ())):
                if abs(i - j) <= band:
                    k = bisect_left(ends, j)
                    ends[k:k + 1] = [j]
        return head + tail + len(ends)
    best = np.zeros(len(b) + 1, np.int64)  # many repeats: row by row inside the band
    for i, value in enumerate(a):
        lo, hi = max(0, i - band), min(len(b), i + band + 1)
        row = np.maximum(best[lo + 1:hi + 1], np.where(b[lo:hi] == value, best[lo:hi] + 1, 0))
        best[lo + 1:hi + 1] = np.maximum(np.maximum.accumulate(row), best[lo])
        best[hi + 1:] = np.maximum(best[hi + 1:], best[hi])
    return head + tail + int(best[-1])


class Prepared:
    """A text's shingles, and the distinct ones with their counts."""

    __slots__ = ("sequence", "names", "counts")

    def __init__(self, words: bytes) -> None:
        self.sequence = shingles(np.frombuffer(words, np.uint32))
        self.names, self.counts = np.unique(self.sequence, return_counts=True)


def similarity_of(x: Prepared, y: Prepared, least: float = SIMILARITY) -> float:
    """Share of aligned shingles of two texts; 0 as soon as it must stay below `least`."""
    a, b = x.sequence, y.sequence
    total = len(a) + len(b)
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return 0.0
    _, i, j = np.intersect1d(x.names, y.names, assume_unique=True, return_indices=True)
    shared = int(np.minimum(x.counts[i], y.counts[j]).sum())
    if shared < least * (total - shared):
        return 0.0
    need = int(np.ceil(least / (1 + least) * total - 1e-9))
    matched = _aligned(a, b, max(0, total - 2 * need))
    return matched / (total - matched)


def similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """similarity_of() for two sequences of word hashes."""
    return similarity_of(Prepared(a.tobytes()), Prepared(b.tobytes()), least)


def _similar_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in slices(whole, 2)):
        left, right = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        scores = [similarity_of(Prepared(a), Prepared(b)) for a, b in zip(left, right)]
        keep = pa.array([s >= SIMILARITY for s in scores], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64())],
                                         ["u", "v", "similarity"]).filter(keep)


def verified(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """(u, v) -> (u, v, similarity) of those similar enough. v, which may be one leader for many, is joined first,
    so that the alignments are spread by u."""
    rows = (pairs.join(words.select(F.col("doc_id").alias("v"), F.col("words").alias("v_words")), "v")
            .join(words.select(F.col("doc_id").alias("u"), F.col("words").alias("u_words")), "u")
            .select("u", "v", "u_words", "v_words"))
    return rows.mapInArrow(_similar_rows, "u long, v long, similarity double")


def _kmer_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Labelled k-mers with one text that holds them, and whether another one does; each once per run of texts."""
    for batch in (part for whole in batches for part in slices(whole, most=1 << 23)):
        marked = [labelled(shingles(np.frombuffer(b, np.uint32))) for b in batch.column(1).to_pylist()]
        ids = np.repeat(batch.column(0).to_numpy(), [len(m) for m in marked])
        kmers, first, counts = np.unique(np.concatenate(marked), return_index=True, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(kmers.view(np.int64)), pa.array(ids[first]), pa.array(counts > 1)],
                                         ["kmer", "id", "shared"])


def _with_lone(members: DataFrame, words: DataFrame) -> DataFrame:
    """members with `lone`, the number of k-mers that no other member has, without those that can't have a partner:
    at least 0.8 of a text's k-mers must be in the other text too."""
    ids = members.select("id").distinct()
    kmers = words.join(ids.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi").mapInArrow(
        _kmer_rows, "kmer long, id long, shared boolean")
    lone = (kmers.groupBy("kmer").agg(F.count("*").alias("c"), F.max("shared").alias("shared"), F.min("id").alias("id"))
            .where("c = 1 and not shared").groupBy("id").agg(F.count("*").alias("lone")))
    return members.join(lone, "id", "left").withColumn("lone", F.coalesce("lone", F.lit(0))).where(
        F.col("lone") <= (1 - SIMILARITY) * F.col("n") + 1e-9)


def _fits(n: str, m: str, lone_n: str = "0", lone_m: str = "0") -> Column:
    """Whether two texts of n and m k-mers can be similar enough, given how many of each no other text has."""
    most = F.expr(f"least({n} - {lone_n}, {m} - {lone_m})")
    return most >= SIMILARITY * (F.col(n) + F.col(m) - most)


def _leader_pairs(members: DataFrame) -> DataFrame:
    """Members beside their bucket's smallest id, where they fit each other. Leaders are a table of their own, so that
    the members of a hot bucket can be joined by several tasks."""
    leaders = stored(members.groupBy("band", "key").agg(F.min_by(F.struct("id", "n"), "id").alias("l")), "leaders")
    led = members.join(leaders, ["band", "key"]).select("id", "n", F.col("l.id").alias("leader"), F.col("l.n").alias("m"))
    return led.where("id <> leader").where(_fits("n", "m")).select(F.col("id").alias("u"), F.col("leader").alias("v"))


def near_classes(docs: DataFrame) -> DataFrame:
    """doc_id, exact_id (smallest id with the same words), class_id (smallest id of its near duplicates)."""
    rows = stored(docs.select("doc_id", "text").mapInArrow(
        _sketch_rows, "doc_id long, exact binary, n long, keys array<long>"), "sketches")
    texts = rows.where("exact is not null and doc_id is not null").groupBy("exact").agg(
        F.min("doc_id").alias("exact_id"), F.max("n").alias("n"), F.max("keys").alias("keys"))
    texts = stored(texts, "texts")
    entries = texts.where("n > 0").select(F.col("exact_id").alias("id"), "n", F.posexplode("keys").alias("band", "key"))
    entries = entries.withColumn("band", F.least("band", F.lit(SKETCHES)))  # keys of shortened texts have no order
    shared = entries.groupBy("band", "key").agg(F.count("*").alias("size")).where("size > 1")
    members = stored(entries.join(shared, ["band", "key"]), "members")
    ids = members.select(F.col("id").alias("doc_id")).distinct()
    # the same join at every size: a broadcast would only serve small tables
    words = stored(docs.select("doc_id", "text").where("text is not null").join(ids.hint("merge"), "doc_id", "left_semi")
                   .mapInArrow(_word_rows, "doc_id long, words binary"), "words").dropDuplicates(["doc_id"])

    few = members.where(F.col("size") <= SMALL).select("band", "key", "id", "n")
    pairs = (few.join(few.select("band", "key", F.col("id").alias("v"), F.col("n").alias("m")), ["band", "key"])
             .where((F.col("id") > F.col("v")) & _fits("n", "m"))
             .select(F.col("id").alias("u"), "v").distinct())
    many = members.where(F.col("size") > SMALL).select("band", "key", "id", "n")
    links = stored(verified(pairs.union(_leader_pairs(many)).distinct(), words), "links").select("u", "v")
    tied = components(links)
    last = _left_over(many, tied, texts, words)
    if last is not None:
        last = stored(last, "links")
        if not last.isEmpty():
            tied = components(tied.select(F.col("vertex").alias("u"), F.col("component").alias("v")).union(last))
    texts = texts.select("exact", "exact_id").join(
        tied.select(F.col("vertex").alias("exact_id"), "component"), "exact_id", "left")
    return rows.select("doc_id", "exact").join(texts, "exact", "left").select(
        "doc_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("exact_id", "doc_id")).alias("exact_id"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "exact_id", "doc_id")).alias("class_id"))


def _between(outside: pa.Table, other: pa.Table) -> pa.Table:
    """Links between two blocks of a bucket. A pair belongs to the first band its texts share; to
    the keys of shortened texts if they share none."""
    out: list[tuple[int, int]] = []
    if outside.num_rows and other.num_rows:
        ids, others = outside["id"].to_numpy(), other["id"].to_numpy()
        band = outside["band"][0].as_py()
        n, m = outside["n"].to_numpy()[:, None], other["n"].to_numpy()[None, :]
        most = np.minimum(n - outside["lone"].to_numpy()[:, None], m - other["lone"].to_numpy()[None, :])
        keys, other_keys = (np.array([k[:SKETCHES] for k in t["keys"].to_pylist()], np.int64) for t in (outside, other))
        met = (outside["component"].to_numpy()[:, None] != other["component"].to_numpy()[None, :]) & (
            most >= SIMILARITY * (n + m - most)) & (~other["out"].to_numpy(zero_copy_only=False)[None, :] | (ids[:, None] < others[None, :]))
        left, right = (t["words"].to_pylist() for t in (outside, other))
        kept: dict[int, Prepared] = {}
        for i in np.flatnonzero(met.any(axis=1)).tolist():
            own = Prepared(left[i])
            same = other_keys == keys[i]
            fits = met[i] & (np.where(same.any(axis=1), same.argmax(axis=1), SKETCHES) == band)
            for j in np.flatnonzero(fits).tolist():
                if j not in kept:
                    kept[j] = Prepared(right[j])
                if similarity_of(own, kept[j]) >= SIMILARITY:
                    out.append((int(ids[i]), int(others[j])))
    columns = list(zip(*out)) or [(), ()]
    return pa.table([pa.array(c, pa.int64()) for c in columns], names=["u", "v"])


def _left_over(many: DataFrame, tied: DataFrame, texts: DataFrame, words: DataFrame) -> DataFrame | None:
    """Links (u, v) between the classes of large buckets: those outside a bucket's largest class against all its other
    classes, block by block. Members that the bucket's shortest text shows to have no partner are left out; None if
    nothing is left. A block holds some `BLOCK` k-mers, whatever the size of its bucket."""
    placed = many.join(tied.withColumnRenamed("vertex", "id"), "id", "left").withColumn(
        "component", F.coalesce("component", "id"))
    largest = stored(placed.groupBy("band", "key", "component").agg(F.count("*").alias("c"), F.min("n").alias("least"))
                     .groupBy("band", "key").agg(F.max_by("component", F.struct("c", "component")).alias("main"),
                                                 F.count("*").alias("classes"), F.min("least").alias("least"))
                     .where("classes > 1"), "largest")
    placed = stored(placed.join(largest, ["band", "key"]).drop("classes"), "placed")
    marked = _with_lone(placed, words).withColumn("out", (F.col("component") != F.col("main")) & (
        F.expr("n - lone") >= SIMILARITY * F.expr("greatest(least, n - lone) + lone")))
    marked = stored(marked.select("band", "key", "id", "n", "lone", "component", "out"), "marked")
    left = stored(marked.groupBy("band", "key").agg(
        F.sum(F.col("n") + TEXT).alias("members"), F.sum(F.when(F.col("out"), F.col("n") + TEXT)).alias("outside")).where("outside > 0"), "left")
    if left.isEmpty():
        return None
    full = (marked.join(left, ["band", "key"])
            .join(texts.select(F.col("exact_id").alias("id"), "keys"), "id")
            .join(words.withColumnRenamed("doc_id", "id"), "id")
            .withColumns({"row_blocks": F.ceil(F.col("members") / BLOCK), "out_blocks": F.ceil(F.col("outside") / BLOCK)}))

    def dealt(rows: DataFrame, own: str, own_blocks: str, other: str, other_blocks: str) -> DataFrame:
        return rows.withColumn(own, F.pmod(F.xxhash64("id"), F.col(own_blocks))).withColumn(
            other, F.explode(F.sequence(F.lit(0).cast("long"), F.col(other_blocks) - 1))).drop(
                "row_blocks", "out_blocks", "members", "outside")

    asked = dealt(full.where("out"), "ob", "out_blocks", "rb", "row_blocks")
    rows = dealt(full, "rb", "row_blocks", "ob", "out_blocks")
    rows = rows.toDF(*rows.columns)  # columns of its own, as both sides come from one table
    block = ["band", "key", "ob", "rb"]
    return asked.groupBy(*block).cogroup(rows.groupBy(*block)).applyInArrow(_between, "u long, v long")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, without near duplicates: the smallest id of each class stays. Rows with a null
    id stay; of rows that repeat an id and its text one stays."""
    classes = stored(near_classes(docs), "classes")
    kept = docs.join(classes.where("doc_id = class_id").select("doc_id").distinct(), "doc_id", "left_semi")
    repeated = classes.where("doc_id = class_id").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if repeated.isEmpty():
        return kept.union(docs.where("doc_id is null")).select(*docs.columns)
    once = kept.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return (kept.join(repeated, "doc_id", "left_anti").union(once).union(docs.where("doc_id is null"))
            .select(*docs.columns))


def query(spark, sf_dir: str) -> DataFrame:
    """Every document with the class of its near duplicates."""
    return near_classes(table(spark, sf_dir, "documents"))
