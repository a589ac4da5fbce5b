"""Approximate nearest neighbours by multi-index hashing of learned rotated binary codes.

Rotations are learned (iterative quantisation) on a bounded sample; the signs of a rotated vector are its code. A
code is split into bytes, each byte indexed by its values. A code within Hamming radius r of a query's differs from
it by at most r // bytes in some byte (pigeonhole), so probing every byte's index up to that distance retrieves all
codes within r; these are checked as a whole and reranked by cosine in double precision. The radius is the one that
holds `TARGET` of the true neighbours within the sample, where neighbours lie farther than among all rows.

Rows are dealt to blocks of `BLOCK_BYTES`. A block's rows are sorted before a copy of all queries: a task builds the index
of one block and lets the queries stream past, so every row is shuffled once, every index is built once, and the k best
per query and block are what leaves. If fewer than k codes of a block lie within the radius, its nearest codes fill up,
so a query gets k results if there are k candidates.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and rows with a null id,
take no part; vectors meet those of their own length only; of rows that repeat an id the nearest counts; a query's own
id is no candidate; equal scores go by the smaller id. Empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import stored, table

SAMPLE, CODE_BITS, TARGET, ITERATIONS = 10_000, 256, 0.995, 25
BLOCK_BYTES = 16 << 20  # of a block's components, eight bytes each
COUNTS = np.array([bin(i).count("1") for i in range(256)], np.uint8)


@dataclass
class Codes:
    """Rotations of one vector length, the mean they centre by, and the search radius."""

    mean: np.ndarray
    rotation: np.ndarray
    radius: int

    def of(self, unit: np.ndarray) -> np.ndarray:
        """Codes as rows of bytes."""
        return np.packbits((unit - self.mean) @ self.rotation > 0, axis=1)


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None]


def fit_codes(vectors: np.ndarray, k: int = 5) -> Codes:
    """Learn from a sample of vectors of one length."""
    unit = unit_rows(vectors)
    mean = unit.mean(axis=0)
    centred, dims = unit - mean, vectors.shape[1]
    rng, parts = np.random.default_rng(17), []
    for _ in range(max(1, math.ceil(CODE_BITS / dims))):
        rotation = np.linalg.qr(rng.normal(size=(dims, dims)))[0]
        for _ in range(ITERATIONS):
            left, _, right = np.linalg.svd(np.sign(centred @ rotation).T @ centred)
            rotation = (left @ right).T
        parts.append(rotation)
    codes = Codes(mean, np.hstack(parts), 0)
    packed = codes.of(unit)
    asked = rng.choice(len(unit), min(300, len(unit)), replace=False)
    near = unit[asked] @ unit.T
    near[np.arange(len(asked)), asked] = -2
    true = np.argsort(-near, axis=1)[:, :min(k, max(1, len(unit) - 1))]
    distance = COUNTS[packed[asked][:, None] ^ packed[true]].sum(axis=2)
    codes.radius = int(np.quantile(distance, TARGET))
    return codes


class Index:
    """Byte-wise multi-index over the codes of one block of rows."""

    def __init__(self, codes: np.ndarray) -> None:
        self.codes = codes
        self.orders = np.argsort(codes, axis=0, kind="stable").T
        self.sizes = np.stack([np.bincount(column, minlength=256) for column in codes.T])

    def within(self, code: np.ndarray, radius: int, least: int) -> np.ndarray:
        """Rows whose code is within the radius, and the nearest others if these are under `least`."""
        met = np.zeros(len(self.codes), bool)
        bound = radius // len(code)
        for j, value in enumerate(code):
            probes = COUNTS[np.arange(256) ^ value] <= bound
            met[self.orders[j][np.repeat(probes, self.sizes[j])]] = True
        rows = np.flatnonzero(met)
        distance = COUNTS[self.codes[rows] ^ code].sum(axis=1, dtype=np.int64)
        inside = rows[distance <= radius]
        if len(inside) >= min(least, len(self.codes)):
            return inside
        distance = COUNTS[self.codes ^ code].sum(axis=1, dtype=np.int64)
        last = min(least, len(distance)) - 1
        return np.flatnonzero(distance <= np.partition(distance, last)[last])


def usable(vector: Column) -> Column:
    """Whether a vector takes part; the caller coalesces null to false."""
    inner = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return (F.size(vector) > 0) & inner & F.exists(vector, lambda x: x != 0)


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(values), -1 if len(values) else 0)


class Block:
    """Rows of one block and one vector length, with the index of their codes."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, codes: Codes) -> None:
        self.ids, self.vectors, self.codes = ids, vectors, codes
        self.norms = np.sqrt((vectors * vectors).sum(axis=1))
        self.index = Index(codes.of(unit_rows(vectors)))

    def best(self, names: np.ndarray, questions: np.ndarray, k: int) -> Iterator[tuple[int, int, float]]:
        """(query, row, cosine) of the k rows nearest to each query."""
        for name, question, code in zip(names.tolist(), questions, self.codes.of(unit_rows(questions))):
            own = int((self.ids == name).sum())
            near = self.index.within(code, self.codes.radius, k + own)
            near = near[self.ids[near] != name]
            scores = (self.vectors[near] * question).sum(axis=1) / (self.norms[near] * np.sqrt((question * question).sum()))
            seen: set[int] = set()
            for i in np.lexsort((self.ids[near], -scores)).tolist():
                if int(self.ids[near[i]]) not in seen:
                    seen.add(int(self.ids[near[i]]))
                    yield name, int(self.ids[near[i]]), float(scores[i])
                    if len(seen) == k:
                        break


def _streamed(codes: Broadcast, k: int):
    """Rows come by block and vector length, in each the block's rows before the queries."""
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
                    rows.append(part)
                    continue
                if rows:
                    block = Block(np.concatenate([r["id"].to_numpy() for r in rows]), np.concatenate([_matrix(r["v"]) for r in rows]),
                                  codes.value[int(at[1])])
                    rows = []
                if block is not None:
                    columns = list(zip(*block.best(part["id"].to_numpy(), _matrix(part["v"]), k))) or [[]] * 3
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())],
                        ["query_id", "vec_id", "score"])

    return run


def nearest(rows: DataFrame, asked: DataFrame, k: int = 5, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k rows nearest to each row of `asked`, by cosine."""
    spark = rows.sparkSession

    def taking_part(df: DataFrame) -> DataFrame:
        value = F.col(vector).cast("array<double>")
        return df.select(F.col(id).cast("long").alias("id"), value.alias("v")).where(
            F.col("id").isNotNull() & F.coalesce(usable(F.col("v")), F.lit(False))).withColumn("dim", F.size("v"))

    rows, asked = stored(taking_part(rows), "vectors"), taking_part(asked)
    counts = {r["dim"]: r["n"] for r in rows.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    codes = {}
    for dim, n in counts.items():
        sample = rows.where((F.col("dim") == dim) & (
            F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1_000_000)) < min(1_000_000, math.ceil(1e6 * SAMPLE / n))))
        vectors = _matrix(sample.select("v").limit(2 * SAMPLE).toArrow().column(0))
        if len(vectors):
            codes[dim] = fit_codes(vectors.reshape(len(vectors), dim), k)
        else:
            codes[dim] = fit_codes(_matrix(rows.where(F.col("dim") == dim).select("v").limit(SAMPLE).toArrow().column(0)), k)
    shared = spark.sparkContext.broadcast(codes)
    blocks = max(1, math.ceil(sum(8 * dim * n for dim, n in counts.items()) / BLOCK_BYTES))
    own = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks))).withColumn("asked", F.lit(False))
    copies = asked.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))).withColumn(
        "asked", F.lit(True))
    found = own.unionByName(copies).repartition("block").sortWithinPartitions("block", "dim", "asked").mapInArrow(
        _streamed(shared, k), "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every row whose id is divisible by 50."""
    rows = table(spark, sf_dir, "embeddings")
    return nearest(rows, rows.where(F.col("vec_id") % 50 == 0))
