from __future__ import annotations

import os

import pytest

from lectern.plans import registry

FOLDER = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()
SAMPLE = (
    "search_cards_bm25", "chunk_topk_emphasis", "related_weighted_union", "cluster_cooccurrence",
    "concept_glossary_having", "relevance_histogram", "corpus_snapshot_hash", "reflow_documents",
    "chunk_greedy", "broken_links_anti", "change_plan_full_outer", "first_claim", "citations", "json_salvage",
    "project_log_checked", "project_list_edits", "cluster_delta_parts", "cluster_records", "bridge_inputs", "orphaned_pages",
    "manifest_round_trip", "stage_fingerprints", "deletable_figures", "chunk_annotation_overlap",
    "search_seven_columns", "project_sections_checked", "audit_reviews_merged", "bridges_after_response", "removal_dry_run",
)


def test_every_oracle_has_a_query():
    registry.load_all()
    assert set(registry.ORACLES) <= set(registry.QUERIES)
    assert len(registry.QUERIES) >= 200


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables absent")
@pytest.mark.parametrize("name", SAMPLE)
def test_query_agrees_with_sql(spark, name):
    import duckdb

    from tools.check import rows_of

    registry.load_all()
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    got = rows_of(registry.QUERIES[name](spark, FOLDER).toPandas())
    assert got == rows_of(con.execute(registry.ORACLES[name]).df())
