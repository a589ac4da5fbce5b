from __future__ import annotations

import os
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from conftest_llm import prose  # noqa: E402

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
@pytest.fixture(scope="session")
def documents(spark):
    """Rows -> documents; a row is (doc_id, text) or (doc_id, text, lang)."""
    def build(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", None if r[1] is None else len(r[1])) for r in rows]
        return spark.createDataFrame(full, DOC_SCHEMA)

    return build


@pytest.fixture(scope="session")
def odd_documents(documents):
    """Nulls, empty and very long texts, repeated rows, ties, and extra columns with clashing names."""
    rows = [(1, None), (2, ""), (3, "   \n"), (4, "123 456 !!"), (None, "a text without an id"), (5, prose(1, 60)),
            (5, prose(1, 60)), (6, prose(1, 60)), (7, prose(2, 30_000)), (8, "x" * 20_000), (9, "🙂 ́ ß 你好")]
    extra = {name: F.lit(f"extra {name}") for name in ("n", "keys", "row", "label", "exact", "score", "words", "id")}
    return documents(rows).withColumns(extra)
