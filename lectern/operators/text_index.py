"""Stored positional index of a searchable table: built once, probed by every search.

Three tables: postings (term, key, places, length), in as many term buckets as the session has shuffle partitions; the
rows that hits are shown with (key, carried columns); and one row of corpus statistics. A place is an indexed column's
number and a word's position in it, so phrases and column scopes are answered from the postings and no text is read.
A row's postings are grouped inside its task, some rows at a time, so building shuffles no postings; a search reads the buckets of its own terms.
More text than a task should index is first dealt by key to tasks of bounded text, so that sorting a task's postings never spills.
Postings of such a table are packed (blocks.py): a row of theirs holds what a bucket's terms have in some rows, which are named by
number, and the rows that hits are shown with are a bucket of their own, written by the same tasks: texts are read once for all of it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import reduce
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from lectern.functions.fixed import BM25_B, BM25_IDF_FLOOR, BM25_K1
from lectern.functions.stem import stem
from lectern.functions.text import text_or_empty, word_tokens
from lectern.functions.words import char_classes
from lectern.operators import blocks, postings
from lectern.operators.blocks import FIELD
from lectern.operators.ranking import TextTable
from lectern.operators.tables import stored

WORDS = 500_000  # words that are grouped at a time, about
TASK_TEXT = 32 << 20  # bytes of text that one task indexes, about; its postings take some 20 times as much while they are sorted
PACKED = 2  # times as much text a task indexes where postings are packed; they take some twice as much as the text
ROW_TEXT = 64  # bytes of text that a row counts as besides its own: a task remembers its keys


@dataclass(frozen=True)
class TextIndex:
    """Where an index lies, and what its table was."""

    path: str
    key: str
    fields: tuple[str, ...]
    carry: tuple[str, ...]
    stemmed: bool
    schema: StructType  # of the postings: those of an empty table have no file that tells
    packed: int = 0  # buckets of packed postings

    @property
    def by(self) -> str:
        """What postings name their row by."""
        return "_row" if self.packed else self.key


def _grouped(rows: pa.RecordBatch, fields: int, stemmed: bool) -> pa.RecordBatch:
    """(term, key, places in order, length) of each term of each row; the columns are the key and each field's words."""
    place, row, words, length = [], [], [], np.zeros(rows.num_rows, np.int64)
    for k in range(fields):
        n = pc.fill_null(pc.list_value_length(rows.column(1 + k)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        place.append(np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + k * FIELD)
        row.append(np.repeat(np.arange(rows.num_rows), n))
        words.append(rows.column(1 + k).flatten())
        length += n
    coded = pa.concat_arrays(words).dictionary_encode()
    code, terms = coded.indices.to_numpy(), coded.dictionary
    if stemmed:  # each distinct word once
        stems = pa.array([stem(w) for w in terms.to_pylist()], pa.string()).dictionary_encode()
        code, terms = stems.indices.to_numpy()[code], stems.dictionary
    place, row = np.concatenate(place), np.concatenate(row)
    group = row * len(terms) + code
    order = np.argsort(group, kind="stable")  # fields, and words within them, stay in order
    first = np.flatnonzero(np.diff(group[order], prepend=-1))
    at = order[first]
    places = pa.ListArray.from_arrays(pa.array(np.append(first, len(order)), pa.int32()), pa.array(place[order], pa.int64()))
    return pa.RecordBatch.from_arrays(
        [terms.take(pa.array(code[at])), rows.column(0).take(pa.array(row[at])), places, pa.array(length[row[at]])],
        ["term", rows.schema.names[0], "places", "length"])


def _postings(fields: int, stemmed: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = sum(len(batch.column(1 + k).flatten()) for k in range(fields))
            step = max(1, batch.num_rows * WORDS // max(words, 1))
            for at in range(0, batch.num_rows, step):
                yield _grouped(batch.slice(at, step), fields, stemmed)

    return run


def _shifted(term: int, by: int) -> Column:
    """Where a phrase would start that has this term so many words later."""
    return F.transform(F.coalesce(f"_p{term}", F.array().cast("array<bigint>")), lambda p: p - by)


def _text(table: TextTable) -> int:
    """Bytes of text to index."""
    size = reduce(lambda a, b: a + b, (F.coalesce(F.octet_length(f), F.lit(0)).cast("bigint") for f in table.fields))
    return table.rows.agg(F.coalesce(F.sum(size + ROW_TEXT), F.lit(0))).first()[0]


def _dealt(table: TextTable, total: int | None = None, share: int = 1) -> DataFrame:
    """Key, indexed and carried columns: as they are read where one task can index them all, else dealt by key to as many tasks
    as the text needs, however few or large the files are."""
    total = _text(table) if total is None else total
    rows = table.rows.select(*dict.fromkeys([table.key, *table.fields, *table.carry]))
    if total <= TASK_TEXT:
        return rows
    return rows.repartition(max(-(-total // (TASK_TEXT * share)), rows.sparkSession.sparkContext.defaultParallelism), table.key)


def _pack(table: TextTable, total: int, path: str) -> TextIndex:
    """Postings and rows of a large table, from one reading of its texts."""
    spark = table.rows.sparkSession
    buckets = min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(8, isqrt(total >> 20)))  # files are tasks times buckets
    shown = F.struct(*dict.fromkeys([table.key, *table.carry]))
    texts = _dealt(table, total, PACKED).select(
        F.col(table.key).alias("key"), shown.alias("row"), *[F.lower(text_or_empty(F.col(f))).alias(f"_t{k}") for k, f in enumerate(table.fields)])
    schema = blocks.packed_schema(texts.schema["row"].dataType)
    packed = texts.mapInArrow(blocks.packer(len(table.fields), table.stemmed, buckets, char_classes(spark)), schema)
    packed.sortWithinPartitions("bucket").write.partitionBy("bucket").parquet(f"{path}/postings")
    index = TextIndex(path, table.key, table.fields, table.carry, table.stemmed, schema, buckets)
    n = _rows(index, spark).agg(F.count("*").alias("n"), F.coalesce(F.sum("_len"), F.lit(0)).alias("words"))
    n.select("n", F.try_divide("words", "n").alias("average")).coalesce(1).write.parquet(f"{path}/statistics")
    return index


def write(table: TextTable, path: str) -> TextIndex:
    if table.derived:
        table = replace(table, rows=stored(table.rows.select(*dict.fromkeys([table.key, *table.fields, *table.carry])), "derived"))
    total = _text(table)
    if total > TASK_TEXT:
        return _pack(table, total, path)
    words = _dealt(table, total).select(table.key, *[word_tokens(F.col(f)).alias(f"_w{k}") for k, f in enumerate(table.fields)])
    key = words.schema[table.key].dataType.simpleString()
    grouped = words.mapInArrow(
        _postings(len(table.fields), table.stemmed), f"term string, `{table.key}` {key}, places array<bigint>, length bigint")
    schema = StructType([*grouped.schema.fields, StructField("buckets", IntegerType()), StructField("bucket", IntegerType())])
    postings.write(grouped, f"{path}/postings")
    table.rows.select(table.key, *table.carry).write.parquet(f"{path}/rows")
    spark = table.rows.sparkSession
    # every word stands in the postings once, so that the texts need not be tokenised again for their mean length
    words = spark.read.schema(schema).parquet(f"{path}/postings").agg(F.coalesce(F.sum(F.size("places")), F.lit(0)).alias("words"))
    n = spark.read.parquet(f"{path}/rows").agg(F.count("*").alias("n"))
    n.crossJoin(words).select("n", F.try_divide("words", "n").alias("average")).coalesce(1).write.parquet(f"{path}/statistics")
    return TextIndex(path, table.key, table.fields, table.carry, table.stemmed, schema)


def _rows(index: TextIndex, spark: SparkSession) -> DataFrame:
    """Rows that hits are shown with: those of a packed index with the number that its postings name them by."""
    if not index.packed:
        return spark.read.parquet(f"{index.path}/rows")
    rows = spark.read.schema(index.schema).parquet(f"{index.path}/postings").where(F.col("bucket") == blocks.ROWS)
    return rows.select((F.col("task") * blocks.TASK_ROWS + F.col("row._number")).alias("_row"), "row.*").drop("_number")


def _places(index: TextIndex, spark: SparkSession, terms: list[str]) -> DataFrame:
    """One row per document that holds any of the terms, with the places of each of them."""
    found = spark.read.schema(index.schema).parquet(f"{index.path}/postings")
    if index.packed:
        own = found.where(F.col("bucket").isin(*set(blocks.bucket(pa.array(terms), index.packed).tolist()))).select("task", "terms", "ends", "postings")
        hit = own.mapInArrow(blocks.unpacker(len(index.fields), terms), blocks.UNPACKED)
    else:
        hit = postings.probe(found, terms)
    length = [] if index.packed else [F.first("length").alias("_len")]
    return hit.groupBy(index.by).agg(*length, *[
        F.max(F.when(F.col("term") == t, F.col("places"))).alias(f"_p{i}") for i, t in enumerate(terms)])


def _count(phrase: list[str], terms: list[str], field: int | None) -> Column:
    """Places where the phrase's words stand one after another in one column."""
    starts = reduce(F.array_intersect, [_shifted(terms.index(w), k) for k, w in enumerate(phrase)])
    if field is not None:
        starts = F.filter(starts, lambda p: p.between(field * FIELD, (field + 1) * FIELD - 1))
    return F.size(starts)


def bm25(index: TextIndex, spark: SparkSession, phrases: list[list[str]], only: str | None = None) -> DataFrame:
    """What ranking.bm25() gives for the indexed table: key, carried columns, score of the rows that match."""
    rows = _rows(index, spark)
    if index.stemmed:
        phrases = [[stem(w) for w in p] for p in phrases]
    if not phrases:
        return rows.select(index.key, *index.carry, F.lit(0.0).alias("score")).where("false")
    terms = list(dict.fromkeys(w for p in phrases for w in p))
    field = index.fields.index(only) if only else None
    counted = _places(index, spark, terms).select(index.by, *([] if index.packed else ["_len"]), *[
        _count(p, terms, field).alias(f"_tf{i}") for i, p in enumerate(phrases)])
    frequent = counted.agg(F.struct(*[F.count_if(F.col(f"_tf{i}") > 0).alias(f"df{i}") for i in range(len(phrases))])).scalar()
    corpus = spark.read.parquet(f"{index.path}/statistics").agg(F.struct(F.max("n").alias("n"), F.max("average").alias("average"))).scalar()
    hits = counted.where(reduce(lambda a, b: a | b, (F.col(f"_tf{i}") > 0 for i in range(len(phrases)))))
    if index.packed:  # rows of one key share its postings
        shown = rows.where(F.col(index.key).isNotNull()) if index.carry else rows.groupBy("_row").agg(
            *[F.first(c).alias(c) for c in (index.key, "_len")])
        hits = hits.join(shown, "_row")
    hits = hits.withColumn("_df", frequent).withColumn("_all", corpus)
    norm = BM25_K1 * (1 - BM25_B + BM25_B * F.col("_len") / F.col("_all.average"))
    score = F.lit(0.0)
    for i in range(len(phrases)):
        idf = F.log((F.col("_all.n") - F.col(f"_df.df{i}") + 0.5) / (F.col(f"_df.df{i}") + 0.5))
        tf = F.col(f"_tf{i}")
        score = score + F.when(idf <= 0, F.lit(BM25_IDF_FLOOR)).otherwise(idf) * tf * (BM25_K1 + 1) / (tf + norm)
    if index.packed:
        return hits.select(index.key, *index.carry, score.alias("score"))
    scored = hits.select(index.key, score.alias("score"))
    return scored.join(rows, index.key).select(index.key, *index.carry, "score") if index.carry else scored
