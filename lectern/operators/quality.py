"""Health detectors: each yields rows of one common issue schema."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ISSUE = ("issue", "severity", "material_id", "detail")


def issue(rows: DataFrame, kind: str, severity: str, material: Column, detail: Column) -> DataFrame:
    return rows.select(
        F.lit(kind).alias("issue"), F.lit(severity).alias("severity"),
        material.cast("string").alias("material_id"), detail.alias("detail"))


def missing_fields(fields: dict[str, Column]) -> Column:
    """Comma-separated names of the fields that are null or empty."""
    named = [F.when(c.isNull() | (c.cast("string") == ""), F.lit(n)) for n, c in fields.items()]
    return F.array_join(F.array_compact(F.array(*named)), ", ")


def absent(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of ``left`` whose key does not occur in ``right``."""
    return left.join(right.select(key), key, "left_anti")


def report(issues: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, issues)


def severity_totals(issues: DataFrame) -> DataFrame:
    return issues.groupBy("issue", "severity").agg(F.count(F.lit(1)).alias("n"))
