"""Registry of named queries and the SQL each must agree with."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: query name -> ids of the inventory rows it answers
COVERS: dict[str, str] = {}

MODULES = (
    "search", "related", "graph", "aggregates", "texts", "chunks", "linking", "health", "incremental", "deltas",
    "evidence", "ordering", "extraction", "projections", "maintenance", "projects", "publication", "clusters", "wiki", "bridges",
    "published_graph", "audit", "bridge_sets", "removal",
)


def query(name: str, covers: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query function under ``name``."""

    def add(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = function
        COVERS[name] = covers
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add


def load_all() -> None:
    for module in MODULES:
        importlib.import_module(f"lectern.plans.{module}")
