"""Helpers shared by the operators: table access, stored intermediate results, array folds."""

from __future__ import annotations

import tempfile
import unicodedata
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a new one of our own where that is unset (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        folder = tempfile.mkdtemp(prefix="lectern-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stored(df: DataFrame, label: str) -> DataFrame:
    """df written once as Parquet in the shared folder and read back: lineage ends here, columns stay prunable."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def composed(text: str) -> str:
    """text with its accents composed (NFC)."""
    return text if text.isascii() else unicodedata.normalize("NFC", text)


def slices(batch: pa.RecordBatch, column: int = 1, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in runs of at most `most` text bytes (one row at least), so that what a worker builds
    beside the texts stays small whatever their lengths."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends, start = np.cumsum(sizes), 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def bind(value: Column, use) -> Column:
    """use(value) with value computed once: a lambda variable is not inlined into every use."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running_sums(lengths: Column, block: int = 256) -> Column:
    """Exclusive prefix sums of an int array, in blocks, so that an array of n costs n * block and not n * n."""
    def tail(sums: Column, value: Column) -> Column:
        return F.concat(sums, F.array(F.element_at(sums, -1) + value))

    def inner(chunk: Column, start: Column) -> Column:
        sums = F.aggregate(chunk, F.array(start), tail)
        return F.slice(sums, 1, F.size(sums) - 1)

    def blocks(values: Column) -> Column:
        count = F.ceil(F.size(values) / F.lit(block)).cast("int")
        chunks = F.transform(F.sequence(F.lit(0), count - 1),
                             lambda b: F.slice(values, b * block + 1, block))
        return bind(chunks, lambda parts: bind(
            F.aggregate(F.transform(parts, lambda p: F.aggregate(p, F.lit(0), lambda a, x: a + x)),
                        F.array(F.lit(0)), tail),
            lambda starts: F.flatten(F.zip_with(parts, F.slice(starts, 1, F.size(parts)), inner))))

    return F.when(F.size(lengths) > 0, bind(lengths, blocks)).otherwise(F.array().cast("array<int>"))
