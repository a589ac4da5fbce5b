"""Hard negatives of anchor vectors, with exact integer scores by residue-number-system multiplication.

Components are quantised to integers. A score is the integer inner product of two rows: both matrices are reduced
modulo several primes below 1,024 and multiplied in float32, 64 components at a time, so that every partial sum stays
below 2^24 and is exact; the residues of a score give its mixed-radix digits, and these its signed value (Chinese
remaindering). There are as many primes as the largest norm needs, which is measured over all rows.

Rows are dealt to blocks of `BLOCK_BYTES`. Each block's rows are sorted before a copy of all anchors, so a task holds one
block and lets the anchors stream past: every row is shuffled once per pass, and what is copied is an anchor per block.
The first pass multiplies anchors with the rows of their own label and keeps the best `positives` of each block; the second
one knows each anchor's positives and keeps the best rows of other labels inside each positive's window of scores.
What a block keeps for an anchor are a few rows at most, whatever the number of ties or copies.

Defined results: rows with a null id or label, or a vector that is null, empty, or holds null or non-finite components
take no part; vectors meet those of their own length only; of rows that repeat an id the one with the smallest label and vector
counts; ties go by the smaller id; an anchor without positives, or a positive without a row inside its window, gives
no rows. Components whose scores could exceed a long raise an error. Other columns can have any name. An empty table
gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import stored, table

SCALE = 256
WIDTH = 64  # components multiplied at once: 64 * 511 ** 2 < 2 ** 24
BLOCK_BYTES = 16 << 20  # of a block's components, four bytes each
CELLS = 1 << 21  # scores computed at once
LOW, HIGH = 80, 100  # percent of a positive's score


def primes_for(bound: int, below: int = 1024) -> list[int]:
    """The largest primes whose product exceeds twice the bound."""
    chosen, product = [], 1
    for n in range(below - 1, 2, -1):
        if product > 2 * bound:
            return chosen
        if all(n % d for d in range(2, math.isqrt(n) + 1)):
            chosen.append(n)
            product *= n
    raise ValueError("components too large")


def _near_zero(values: np.ndarray, p: int) -> np.ndarray:
    """values modulo p, from -(p - 1) / 2 to (p - 1) / 2; whole numbers that their float type holds exactly."""
    return values - p * np.rint(values / p)


class Residues:
    """A matrix of whole numbers modulo each prime, in float32."""

    def __init__(self, values: np.ndarray, primes: list[int]) -> None:
        self.parts = [_near_zero(np.fmod(values, p), p).astype(np.float32) for p in primes]

    def rows(self, at: np.ndarray | slice) -> list[np.ndarray]:
        return [part[at] for part in self.parts]


def products(left: list[np.ndarray], right: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """Exact inner products of all rows of two matrices given by their residues."""
    digits: list[np.ndarray] = []
    for a, b, p in zip(left, right, primes):
        total = np.zeros((len(a), len(b)), np.float32)
        for k in range(0, a.shape[1], WIDTH):
            total = _near_zero(total + _near_zero(a[:, k:k + WIDTH] @ b[:, k:k + WIDTH].T, np.float32(p)), np.float32(p))
        # digits in mixed radix so far: subtract them, divide by their base, modulo p
        for digit, q in zip(digits, primes):
            turned = pow(q, -1, p)
            turned -= p * (turned > p // 2)
            total = _near_zero((total - _near_zero(digit, np.float32(p))) * np.float32(turned), np.float32(p))
        digits.append(total)
    out, base = np.zeros(digits[0].shape, np.int64), 1
    for digit, p in zip(digits, primes):
        out += digit.astype(np.int64) * base
        base *= p
    return out


class Best:
    """The first `k` (score, id) pairs of each slot, higher scores and then smaller ids first, over several offers."""

    def __init__(self, slots: int, k: int) -> None:
        self.scores = np.full((slots, k), -np.iinfo(np.int64).max)
        self.ids = np.full((slots, k), np.iinfo(np.int64).max)

    def reached(self, slot: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Which offers come before the last one held."""
        last, last_id = self.scores[slot, -1], self.ids[slot, -1]
        return (scores > last) | ((scores == last) & (ids < last_id))

    def offer(self, slot: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        keep = self.reached(slot, scores, ids)
        slot, scores, ids = slot[keep], scores[keep], ids[keep]
        if not len(slot):
            return
        met, k = np.unique(slot), self.scores.shape[1]
        all_slots = np.concatenate([np.repeat(met, k), slot])
        all_scores, all_ids = np.concatenate([self.scores[met].ravel(), scores]), np.concatenate([self.ids[met].ravel(), ids])
        order = np.lexsort((all_ids, -all_scores, all_slots))
        all_slots = all_slots[order]
        first = np.flatnonzero(np.diff(all_slots, prepend=-1))
        place = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
        order, slots, place = order[place < k], all_slots[place < k], place[place < k]
        self.scores[slots, place], self.ids[slots, place] = all_scores[order], all_ids[order]

    def held(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        slot, place = np.nonzero(self.ids != np.iinfo(np.int64).max)
        return slot, self.scores[slot, place], self.ids[slot, place]


class Block:
    """Rows of one block and one vector length, sorted by label."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, values: np.ndarray, primes: list[int]) -> None:
        order = np.lexsort((ids, labels))
        self.ids, self.labels, self.primes = ids[order], labels[order], primes
        self.residues = Residues(values[order], primes)

    def _pieces(self, anchors: int) -> Iterator[slice]:
        step = max(1, CELLS // max(1, anchors))
        yield from (slice(s, min(s + step, len(self.ids))) for s in range(0, len(self.ids), step))

    def same_label(self, ids: np.ndarray, labels: np.ndarray, residues: Residues, k: int) -> tuple[np.ndarray, ...]:
        """anchor number, score, id of the k first rows of each anchor's own label, without the anchor's own id."""
        best = Best(len(ids), k)
        for label in np.unique(labels).tolist():
            asked = np.flatnonzero(labels == label)
            start, stop = np.searchsorted(self.labels, [label, label], side="left")[0], np.searchsorted(self.labels, label, side="right")
            for piece in self._pieces(len(asked)):
                at = slice(max(piece.start, start), min(piece.stop, stop))
                if at.start >= at.stop:
                    continue
                scores = products(residues.rows(asked), self.residues.rows(at), self.primes)
                names = np.broadcast_to(self.ids[at], scores.shape)
                slots = np.broadcast_to(asked[:, None], scores.shape)
                fits = best.reached(slots, scores, names) & (names != ids[asked][:, None])
                best.offer(slots[fits], scores[fits], names[fits])
        return best.held()

    def other_labels(self, ids: np.ndarray, labels: np.ndarray, residues: Residues, least: np.ndarray, most: np.ndarray,
                     k: int) -> tuple[np.ndarray, ...]:
        """slot (anchor number times windows, plus the window's number), score, id of the k first rows of other labels
        inside each window; least and most hold the windows of each anchor, an empty one where it has no more."""
        windows = least.shape[1]
        best = Best(len(ids) * windows, k)
        highest = most.max(axis=1)
        for at in self._pieces(len(ids)):
            # below what its windows ask for, or hold already, no row matters to an anchor
            floors = np.maximum(least, best.scores[:, -1].reshape(least.shape))
            lowest = np.where(least <= most, floors, np.iinfo(np.int64).max).min(axis=1)
            scores = products(residues.parts, self.residues.rows(at), self.primes)
            near = (scores >= lowest[:, None]) & (scores <= highest[:, None]) & (labels[:, None] != self.labels[at][None, :])
            anchor, row = np.nonzero(near)
            values, names = scores[anchor, row], self.ids[at][row]
            for w in range(windows):
                inside = (values >= least[anchor, w]) & (values <= most[anchor, w])
                best.offer(anchor[inside] * windows + w, values[inside], names[inside])
        return best.held()


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _streamed(answer: Callable[[Block, pa.RecordBatch, Residues], pa.RecordBatch], names: list[str], primes: list[int]):
    """Rows come by block and vector length, in each the block's rows before the anchors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[pa.RecordBatch] = []
        at, block = None, None
        for batch in batches:
            place = np.stack([batch[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("block", "dim", "asked")], axis=1)
            turns = np.flatnonzero((np.diff(place, axis=0) != 0).any(axis=1)) + 1
            for start, stop in zip([0, *turns.tolist()], [*turns.tolist(), batch.num_rows]):
                if start == stop:
                    continue
                part = batch.slice(start, stop - start)
                if at != tuple(place[start, :2]):
                    at, rows, block = tuple(place[start, :2]), [], None
                if not place[start, 2]:
                    rows.append(part.select(["id", "label", "v"]))
                    continue
                if rows:
                    block = Block(*(np.concatenate([r[c].to_numpy() for r in rows]) for c in ("id", "label")),
                                  np.concatenate([_matrix(r["v"]) for r in rows]), primes)
                    rows = []
                if block is not None:
                    yield answer(block, part, Residues(_matrix(part["v"]), primes))

    return run


def _dealt(rows: DataFrame, anchors: DataFrame, blocks: int) -> DataFrame:
    """Every row in its block, with a copy of every anchor after the rows of each block."""
    own = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks))).withColumn("asked", F.lit(False))
    copies = anchors.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))).withColumn(
        "asked", F.lit(True))
    return own.unionByName(copies, allowMissingColumns=True).repartition("block").sortWithinPartitions("block", "dim", "asked", "label")


def _first(rows: DataFrame, group: list[str], k: int, id: str) -> DataFrame:
    order = Window.partitionBy(*group).orderBy(F.desc("score"), id)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def taking_part(df: DataFrame, id: Column, label: Column, vector: Column, scale: int = SCALE) -> DataFrame:
    """id, label, v (whole numbers as doubles) and dim of the rows that take part, one per id."""
    whole = F.forall("raw", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    rows = df.select(id.cast("long").alias("id"), label.cast("long").alias("label"),
                     F.transform(vector.cast("array<double>"), lambda x: x * scale).alias("raw"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("raw") > 0) & F.coalesce(whole, F.lit(False)))
    # floor() gives a long; beyond 2 ** 53 every double is whole
    rows = rows.withColumn("v", F.transform("raw", lambda x: F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(x)))
    one = rows.groupBy("id").agg(F.min(F.struct("label", "v")).alias("r"))
    return one.select("id", "r.label", "r.v", F.size("r.v").alias("dim"))


def mined(df: DataFrame, is_anchor: Column, id: Column, label: Column, vector: Column, positives: int = 5, negatives: int = 5
          ) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; is_anchor reads the column `id`."""
    rows = stored(taking_part(df, id, label, vector), "vectors")
    norm = F.aggregate("v", F.lit(0.0), lambda total, x: total + x * x)
    extent = rows.agg(F.max(norm).alias("norm"), F.sum(F.lit(4) * F.col("dim")).alias("bytes")).first()
    if (extent["norm"] or 0) * 1.001 >= 2.0**62:
        raise ValueError("components too large: scores don't fit in a long")
    primes = primes_for(math.ceil((extent["norm"] or 0) * 1.001) + 1)
    blocks = max(1, math.ceil((extent["bytes"] or 0) / BLOCK_BYTES))
    anchors = rows.where(is_anchor)

    def nearest(block: Block, part: pa.RecordBatch, residues: Residues) -> pa.RecordBatch:
        ids, labels = part["id"].to_numpy(), part["label"].to_numpy()
        slot, scores, names = block.same_label(ids, labels, residues, positives)
        return pa.RecordBatch.from_arrays([*map(pa.array, (ids[slot], names, scores))], ["anchor_id", "positive_id", "score"])

    names = ["anchor_id", "positive_id", "score"]
    near = _dealt(rows, anchors, blocks).mapInArrow(
        _streamed(nearest, names, primes), "anchor_id long, positive_id long, score long")
    found = stored(_first(near, ["anchor_id"], positives, "positive_id").drop("rank"), "positives")
    # of at most `positives` entries
    known = found.groupBy(F.col("anchor_id").alias("id")).agg(F.sort_array(
        F.collect_list(F.struct("score", "positive_id"))).alias("p"))
    asked = anchors.join(known, "id").select("id", "label", "v", "dim", F.col("p.score").alias("scores"),
                                             F.col("p.positive_id").alias("names"))

    def inside(block: Block, part: pa.RecordBatch, residues: Residues) -> pa.RecordBatch:
        ids, labels = part["id"].to_numpy(), part["label"].to_numpy()
        held = part["scores"].value_lengths().to_numpy()
        filled = np.arange(positives)[None, :] < held[:, None]
        own, least, most = (np.zeros(filled.shape, np.int64) for _ in range(3))
        own[filled] = part["names"].flatten().to_numpy()
        top = part["scores"].flatten().to_numpy()
        most[filled], least[filled] = top, -(-LOW * top // HIGH)
        least[~filled] = 1  # an empty window
        slot, scores, names = block.other_labels(ids, labels, residues, least, most, negatives)
        a, w = slot // positives, slot % positives
        return pa.RecordBatch.from_arrays([*map(pa.array, (ids[a], own[a, w], most[a, w], names, scores))],
                                          ["anchor_id", "positive_id", "positive_score", "negative_id", "score"])

    hard = _dealt(rows, asked, blocks).mapInArrow(
        _streamed(inside, names, primes),
        "anchor_id long, positive_id long, positive_score long, negative_id long, score long")
    return _first(hard, ["anchor_id", "positive_id"], negatives, "negative_id").select(
        "anchor_id", "positive_id", F.col("rank").cast("int"), "negative_id", "positive_score", F.col("score").alias("negative_score"))


def query(spark, sf_dir: str) -> DataFrame:
    """The hard negatives of every row whose id is divisible by 100."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mined(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, F.col("vec_id"), label, F.col("embedding"))


#: Scores and windows of all anchors and rows in SQL.
SQL = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, x -> floor(256 * CAST(x AS DOUBLE))) AS v
           FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, x -> x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same,
                  CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score
           FROM e a JOIN e r ON r.vec_id <> a.vec_id AND len(a.v) = len(r.v) WHERE a.vec_id % 100 = 0),
     p AS (SELECT anchor_id, vec_id AS positive_id, score FROM s WHERE same
           QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank,
       n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.same
  AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score
QUALIFY rank <= 5
"""
