"""Inverted index: one row per (term, document), written once, probed often."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.fixed import BM25_B, BM25_IDF_FLOOR, BM25_K1
from lectern.functions.text import word_tokens

def build(rows: DataFrame, key: str, field: str) -> DataFrame:
    """(term, document, tf, length) rows; the document length rides along."""
    tokens = rows.select(key, F.inline(F.transform(
        F.array(word_tokens(F.col(field))), lambda t: F.struct(F.size(t).alias("length"), t.alias("terms")))))
    exploded = tokens.select(key, "length", F.explode("terms").alias("term"))
    return exploded.groupBy("term", key).agg(F.count(F.lit(1)).alias("tf"), F.first("length").cast("bigint").alias("length"))


def lengths(rows: DataFrame, key: str, field: str) -> DataFrame:
    return rows.select(key, F.size(word_tokens(F.col(field))).cast("bigint").alias("length"))


def term_stats(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("documents"), F.sum("tf").alias("uses"))


def write(postings: DataFrame, path: str, buckets: int | None = None) -> None:
    """Parquet partitioned by term bucket, as many as the session has shuffle partitions unless told otherwise; the
    number is part of the layout. Each task writes its own part of every bucket: nothing is shuffled, and
    no task holds more than its own rows, however frequent a term is."""
    buckets = buckets or int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bucketed = postings.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))
    # by bucket only, which is what the write needs: comparing all terms took half as long again as all other steps
    bucketed.sortWithinPartitions("bucket").write.mode("overwrite").partitionBy("bucket").parquet(
        f"{path}/buckets={buckets}")


def probe(postings: DataFrame, terms: list[str]) -> DataFrame:
    """Only the query's postings: bucket pruning first, then the term filter."""
    hit = postings.where(F.col("term").isin(*terms))
    if "bucket" in postings.columns:
        wanted = [F.pmod(F.xxhash64(F.lit(t)), F.col("buckets").cast("bigint")).cast("int") for t in terms]
        hit = hit.where(reduce(lambda a, b: a | b, (F.col("bucket") == w for w in wanted)))
    return hit


def bm25(postings: DataFrame, doc_lengths: DataFrame, key: str, terms: list[str]) -> DataFrame:
    """Score documents from the postings of the query's terms."""
    hit = probe(postings, terms)
    corpus = doc_lengths.agg(F.struct(F.count(F.lit(1)).alias("n"), F.avg("length").alias("avg")).alias("s")).scalar()
    stats = hit.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log((F.col("c.n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = stats.withColumn("c", corpus).select(
        "term", F.when(idf <= 0, F.lit(BM25_IDF_FLOOR)).otherwise(idf).alias("idf"), F.col("c.avg").alias("avg"))
    norm = BM25_K1 * (1 - BM25_B + BM25_B * F.col("length") / F.col("avg"))
    part = F.col("idf") * F.col("tf") * (BM25_K1 + 1) / (F.col("tf") + norm)
    return hit.join(weighed, "term").groupBy(key).agg(F.sum(part).alias("score"))
