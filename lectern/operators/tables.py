"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir; below one of our own where that is unset, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        base = tempfile.mkdtemp(prefix="lectern-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def spread(df: DataFrame, total: int, *keys: str, share: int = 1_000_000) -> DataFrame:
    """df, of some `total` rows, dealt by keys to more partitions the more rows it has: a task's share doesn't grow with the
    input."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(partitions, -(-total // share)), *keys)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once as Parquet and read back, so that its lineage ends and lost executors cost no more than a read."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
