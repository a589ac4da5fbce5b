"""Sinks: staged publication, manifests, pages and JSON results."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEPT = 50  # entries of a version log


def _file_system(df: DataFrame, path: str):
    spark = df.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def publish(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """Write a new version of one table below ``path``, then let the version log name it as the current one."""
    version = uuid.uuid4().hex
    df.write.partitionBy(*partition_by).parquet(f"{path}/versions/{version}")
    _commit(df, path, version)


def publish_all(tables: dict[str, DataFrame], path: str) -> None:
    """The same for tables that belong together: one entry of the log names the version of all of them."""
    version = uuid.uuid4().hex
    for name, df in tables.items():
        df.write.parquet(f"{path}/versions/{version}/{name}")
    _commit(next(iter(tables.values())), path, version)


def _commit(df: DataFrame, path: str, version: str) -> None:
    """Append an entry to the log. A version is complete before an entry names it, and no older one is touched, so
    readers always find whole tables; whatever fails before leaves the last version current. A number is taken by
    creating its file, which only one publisher can; another one takes the next. Entries before the last `KEPT` go."""
    fs, log = _file_system(df, f"{path}/log")
    fs.mkdirs(log)
    while True:
        numbers = _numbers(fs, log)
        entry = log.suffix(f"/{(numbers[-1] if numbers else 0) + 1:012d}")
        try:
            out = fs.create(entry, False)
        except Py4JJavaError:
            if not fs.exists(entry):
                raise
            continue
        out.write(bytearray(version.encode()))
        out.close()
        for old in numbers[:-KEPT]:
            fs.delete(log.suffix(f"/{old:012d}"), False)
        return


def _numbers(fs, log) -> list[int]:
    """Numbers of the entries that are written; one that is still empty isn't there yet for readers, but is taken."""
    return sorted(int(s.getPath().getName()) for s in fs.listStatus(log) if s.getPath().getName().isdigit())


def _current(spark: SparkSession, path: str) -> str:
    """Name of the current version; a few entries of the log are looked at, newest first."""
    fs, log = _file_system(spark.range(0), f"{path}/log")
    for number in reversed(_numbers(fs, log) if fs.exists(log) else []):
        entry = log.suffix(f"/{number:012d}")
        if fs.getFileStatus(entry).getLen() > 0:
            return spark.read.text(entry.toString()).first()[0]
    raise FileNotFoundError(f"nothing is published at {path}")


def published(spark: SparkSession, path: str) -> DataFrame:
    """The current version of a published table."""
    return spark.read.parquet(f"{path}/versions/{_current(spark, path)}")


def published_all(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    """Tables of the current version, all of the same one."""
    version = _current(spark, path)
    return {name: spark.read.parquet(f"{path}/versions/{version}/{name}") for name in names}


def write_manifest(df: DataFrame, path: str) -> None:
    """JSON lines ordered by id across part files; no single writer task."""
    df.orderBy("material_id").write.mode("overwrite").json(path)


def write_pages(pages: DataFrame, path: str) -> None:
    """One text file folder per page path."""
    pages.select("path", F.col("content").alias("value")).write.mode("overwrite").option("lineSep", "\u0000").partitionBy("path").text(path)


def as_json(df: DataFrame, name: str = "json") -> DataFrame:
    """Every row as one JSON object, fields in column order."""
    return df.select(F.to_json(F.struct(*df.columns)).alias(name))


def append_ignored(ignored: DataFrame, added: DataFrame) -> DataFrame:
    """Ignore list with new entries, one per file hash."""
    return ignored.unionByName(added, allowMissingColumns=True).dropDuplicates(["file_hash"])
