"""The library watcher as a streaming query: snapshot, plan, write."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lectern.operators.incremental import change_plan
from lectern.sources import readers


def watch_library(
    spark: SparkSession, root: str, manifest: Callable[[], DataFrame], ignored: Callable[[], DataFrame],
    target: str, checkpoint: str, interval: str | None = None,
) -> StreamingQuery:
    """Plan library changes whenever new or rewritten files arrive.

    New files only wake the query; each batch compares the whole live library
    with the current manifest, because removals never arrive as files. Without
    ``interval`` the query drains what is there and stops; with it, it fires on
    that period. A batch's plan is written under its own id, so a repeated
    batch overwrites itself.
    """
    schema = spark.read.format("binaryFile").load(root).schema
    arrivals = (
        spark.readStream.format("binaryFile").schema(schema)
        .option("recursiveFileLookup", True).load(root).select("path"))

    def plan(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        live = readers.snapshot(readers.scan_library(session, root))
        actions = change_plan(manifest(), live, ignored())
        actions.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    writer = arrivals.writeStream.foreachBatch(plan).option("checkpointLocation", checkpoint)
    trigger = writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)
    return trigger.start()


def resume(done: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Work left after an interrupted run: everything without a finished entry."""
    return wanted.join(done.select(key), key, "left_anti")
