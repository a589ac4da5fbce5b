"""Indexes of the searchable tables: built by the first search of a session, probed by the later ones.

An index belongs to the files it was built from: their names, sizes and times are its stamp, so that changed files get
a new index.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lectern.operators import ranking, text_index
from lectern.operators.ranking import TextTable
from lectern.operators.tables import shared_folder

_BUILT: dict[tuple, text_index.TextIndex] = {}


def _stamp(rows: DataFrame) -> tuple:
    """Names, sizes and times of the files that the rows come from."""
    spark, out = rows.sparkSession, []
    for name in sorted(rows.inputFiles()):
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        status = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
        out.append((name, status.getLen(), status.getModificationTime()))
    return tuple(out)


def index_of(spark: SparkSession, name: str, table: TextTable) -> text_index.TextIndex:
    key = (spark.sparkContext.applicationId, name, table.key, table.fields, table.carry, table.stemmed, _stamp(table.rows))
    if key not in _BUILT:
        _BUILT[key] = text_index.write(table, shared_folder(spark, f"index-{name}"))
    return _BUILT[key]


def search(spark: SparkSession, name: str, table: TextTable, phrases: list[list[str]], only: str | None = None) -> DataFrame:
    """ranking.bm25() from the stored index of the table; a question without words needs no index."""
    if not phrases:
        return ranking.bm25(table, phrases, only)
    return text_index.bm25(index_of(spark, name, table), spark, phrases, only)
