from __future__ import annotations

import pytest

from lectern.plans import registry

registry.load_all()


def test_request_limits_round_halves_to_even(spark, tmp_path):
    rows = [(k, k, "view", v) for k, v in enumerate([2.5, 3.5, 4.5, 2.4, 0.2, 99.0])]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    found = registry.QUERIES["context_requests"](spark, str(tmp_path)).collect()
    assert [r["row_limit"] for r in sorted(found, key=lambda r: r["event_id"])] == [2, 4, 4, 2, 1, 8]


@pytest.mark.parametrize("parts", [1, 3])
def test_change_plan_of_documents_in_one_file_or_a_folder(spark, tmp_path, parts):
    docs = [(i, f"text {i}", "en", f"src{i % 3}", 6) for i in range(40)]
    rows = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(parts)
    if parts == 1:
        rows.toPandas().to_parquet(tmp_path / "documents.parquet")
    else:
        rows.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "https://a.b/c", "<p>x</p>")], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    found = registry.QUERIES["stream_change_plan"](spark, str(tmp_path))
    batch = registry.QUERIES["change_plan_full_outer"](spark, str(tmp_path))
    assert found.count() > 0 and sorted(map(tuple, found.collect())) == sorted(map(tuple, batch.collect()))
