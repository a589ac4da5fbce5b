"""Readers of a document library and its derived artifacts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lectern.functions.names import collection_or_default, domain_or_default
from lectern.functions.text import bind
from lectern.schemas import MANIFEST
from lectern.sources import paths


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether a path or glob matches anything, asked of its own file system."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    found = target.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(target)
    return found is not None and len(found) > 0


def scan_library(spark: SparkSession, root: str, ignored_extensions: tuple[str, ...] = ()) -> DataFrame:
    """Supported files below ``root``. ``content`` is a column that is only read where it is selected."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    prefix = root.rstrip("/") + "/"
    relative = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), "^" + prefix.replace(".", r"\."), "")
    rows = files.select("path", "modificationTime", "length", "content").withColumn("relative_path", relative)
    rows = rows.where(paths.supported(F.col("relative_path"), ignored_extensions))
    return rows.select(
        "path", "relative_path", "modificationTime", "length", "content",
        paths.file_type(F.col("relative_path")).alias("file_type"),
        paths.domain(F.col("relative_path")).alias("domain"),
        paths.collection(F.col("relative_path")).alias("collection"),
    )


def snapshot(files: DataFrame) -> DataFrame:
    """Path, hash and id of every scanned file."""
    return files.select(
        F.col("relative_path").alias("path"), F.sha2("content", 256).alias("file_hash"),
        F.substring(F.sha2("content", 256), 1, 12).alias("material_id"))


def read_jsonl(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """JSON lines; malformed lines are skipped and a missing file is empty."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Manifest keyed by material; the last line of a material wins, in the last of several files by name."""
    if not _exists(spark, path):
        return spark.createDataFrame([], MANIFEST)
    place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id())
    rows = read_jsonl(spark, path, MANIFEST).withColumn("_at", place)
    rest = [c for c in rows.columns if c not in ("material_id", "_at")]
    picked = rows.where("material_id IS NOT NULL").groupBy("material_id").agg(F.max_by(F.struct(*rest), "_at").alias("_r"))
    return picked.select("material_id", *[F.col(f"_r.{c}").alias(c) for c in rest])


def read_artifacts(spark: SparkSession, root: str, name: str, schema: StructType) -> DataFrame:
    """One artifact file of every material folder, tagged with its material."""
    fields = StructType([f for f in schema.fields if f.name != "material_id"])
    rows = read_jsonl(spark, f"{root}/extracted/*/{name}", fields)
    return rows.withColumn("material_id", F.regexp_extract(F.input_file_name(), "/extracted/([^/]+)/", 1))


def enabled_only(rows: DataFrame, domains: tuple[str, ...]) -> DataFrame:
    """Domain cut at the scan, pushed to the partition or file filter."""
    return rows.where(F.col("domain").isin(*domains))


def read_text(files: DataFrame) -> DataFrame:
    """Decode text files; invalid bytes are replaced and noted."""
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    text = F.make_valid_utf8(F.col("content").cast("string"))
    return files.withColumn("text", clean_text(text)).withColumn(
        "warning", F.when(~valid, "non-utf8 bytes in source; decoded with replacement characters"))


def clean_text(text: Column) -> Column:
    return F.regexp_replace(F.translate(text, "\u0000", ""), "\r\n?", "\n")


def markdown_sections(text: Column) -> Column:
    """Array of (heading, body), split at first- and second-level headings.

    Headings inside code fences do not split. One fold per document.
    """
    string = "array<struct<heading:string,body:string>>"
    start = F.struct(
        F.array().cast(string).alias("done"), F.lit("").alias("heading"), F.lit("").alias("body"),
        F.lit(False).alias("fence"), F.lit(True).alias("fresh"))

    def section(acc: Column) -> Column:
        return F.array(F.struct(acc["heading"].alias("heading"), acc["body"].alias("body")))

    def step(acc: Column, line: Column) -> Column:
        mark = line.rlike(r"^\s*(```|~~~)")
        head = ~acc["fence"] & ~mark & line.rlike(r"^#{1,2}\s+\S")
        title = F.regexp_extract(line, r"^#{1,2}\s+(.+?)\s*$", 1)
        longer = F.when(acc["fresh"], line).otherwise(F.concat(acc["body"], F.lit("\n"), line))
        return F.struct(
            F.when(head & ~acc["fresh"], F.concat(acc["done"], section(acc))).otherwise(acc["done"]).alias("done"),
            F.when(head, title).otherwise(acc["heading"]).alias("heading"),
            F.when(head, line).otherwise(longer).alias("body"),
            F.when(mark, ~acc["fence"]).otherwise(acc["fence"]).alias("fence"),
            F.lit(False).alias("fresh"))

    def finish(acc: Column) -> Column:
        return F.concat(acc["done"], section(acc))

    def kept(sections: Column) -> Column:
        trimmed = F.transform(sections, lambda s: F.struct(
            s["heading"].alias("heading"), F.btrim(s["body"], F.lit("\n")).alias("body")))
        return F.filter(trimmed, lambda s: ~s["body"].rlike(r"^\s*$"))

    return bind(F.aggregate(F.split(text, "\n"), start, step, finish), kept)


def parse_with(files: DataFrame, parser: Callable[[str, bytes], list[dict]], schema: StructType) -> DataFrame:
    """Rows produced by an injected file parser (PDF, office, image, figures).

    The parser sees one file at a time inside the tasks; Spark distributes the
    files. Use it for formats that need an external library.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = schema.fieldNames()
        for batch in batches:
            rows = [row for path, content in zip(batch["path"], batch["content"]) for row in parser(path, bytes(content))]
            yield pd.DataFrame(rows, columns=columns)

    return files.select("path", "content").mapInPandas(run, schema)


def capped_sheet(rows: DataFrame, max_rows: int | None = None, max_columns: int | None = None) -> DataFrame:
    """Rows of spreadsheet sheets with truncation flags; whole sheets unless the caller asks for a display cap.

    Rows: material_id, sheet, row (from 1), cells.
    """
    if max_rows is None and max_columns is None:
        return rows.select("material_id", "sheet", "row", "cells", F.lit(False).alias("truncated_rows"),
                           F.lit(False).alias("truncated_columns"))
    max_rows, max_columns = (2**31 - 1 if m is None else m for m in (max_rows, max_columns))
    sizes = rows.groupBy("material_id", "sheet").agg(F.max("row").alias("_rows"), F.max(F.size("cells")).alias("_columns"))
    kept = rows.where(F.col("row") <= max_rows).withColumn("cells", F.slice("cells", 1, max_columns))
    return kept.join(sizes, ["material_id", "sheet"]).select(
        "material_id", "sheet", "row", "cells",
        (F.col("_rows") > max_rows).alias("truncated_rows"), (F.col("_columns") > max_columns).alias("truncated_columns"))


def read_local_clusters(spark: SparkSession, root: str, schema: StructType) -> DataFrame:
    """Cluster files; a missing scope is taken from the folder's name."""
    rows = read_jsonl(spark, f"{root}/derived/collections/*/local_concept_clusters.jsonl", schema)
    folder = F.regexp_extract(F.input_file_name(), "/collections/([^/]+)/", 1)
    return rows.withColumns({
        "domain": domain_or_default(F.coalesce(F.nullif("domain", F.lit("")), F.split_part(folder, F.lit("__"), F.lit(1)))),
        "collection": collection_or_default(F.coalesce(F.nullif("collection", F.lit("")), F.split_part(folder, F.lit("__"), F.lit(2)))),
    })


def bridge_domain(members: Column) -> Column:
    """The members' common domain, empty when they disagree."""
    found = F.array_distinct(F.transform(members, lambda m: m["domain"]))
    return F.when(F.size(found) == 1, F.get(found, F.lit(0))).otherwise("")


def read_only_sql(spark: SparkSession, sql: str, **tables: DataFrame) -> DataFrame:
    """Run a caller's query over named tables. It is run as a subquery, so a statement that writes, drops or sets
    anything does not parse."""
    return spark.sql("SELECT * FROM (" + sql.rstrip().rstrip(";") + "\n)", **tables)


def map_type(kind: Column) -> Column:
    """Annotation kinds of a document viewer to ours; popups are dropped (null)."""
    low = F.lower(kind)
    return F.when(low == "squiggly", "underline").when(low == "text", "note").when(low != "popup", low)
