"""Documents to packed training sequences, in five stages; each works on all that the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of documents.

Defined results: rows with a null or empty text, or without a letter, are of no language and go in the first stage; a null
doc_id is kept by every stage; of rows that repeat an id and its text one stays, of ties among near duplicates the smallest id;
very long texts are worked on whole; extra columns pass the first four stages, but for names that masking uses itself (found,
base_spans, weak_spans, and names that begin with two underscores); empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import decontam, lang_id, near_dup, packing, pii
from lectern.llm.common import stored, table


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or in none of the languages the labelled ones are in, go."""
    return lang_id.known(docs, lang_id.fit(docs, ~lang_id.held_out()))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return near_dup.one_of_each(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are replaced by their kind."""
    return pii.masked(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in training sequences, with their ids and a checksum of them."""
    # workers of earlier stages still hold memory here, so fewer words are kept
    return packing.packed(docs, cached_words=150_000).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [("language_id", languages), ("near_dedup", near_duplicates), ("decontamination", benchmark_leaks),
          ("pii", personal_data), ("packing", sequences)]
ORACLE_SQL = None  # no stage can be expressed in SQL; tests/llm/test_pipeline.py has the brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
