from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from lectern.operators import postings, search
from lectern.operators.ranking import TextTable, best, bm25, query_phrases


@pytest.fixture(scope="module")
def cards(spark):
    rows = [
        (1, "Thermal mass in walls", "heavy walls store heat", "research", "energy"),
        (2, "Light frames", "a study of thermal comfort and mass timber", "practice", "timber"),
        (3, "Non-Western cities", "markets and streets", "research", "urban"),
        (4, "Été à Paris", "river walks", "research", "urban"),
    ]
    return spark.createDataFrame(rows, "id int, title string, text string, domain string, collection string")


def _ids(df):
    return [r["id"] for r in df.orderBy("rank").collect()]


def run(cards, query, **kwargs):
    table = TextTable(cards, "id", ("title", "text"), ("domain", "collection"))
    return search.cards(bm25(table, query_phrases(query), **kwargs), "id", 10)


def test_or_expansion_and_phrases(cards):
    assert set(_ids(run(cards, "thermal walls"))) == {1, 2}
    assert _ids(run(cards, '"thermal mass"')) == [1]
    assert _ids(run(cards, "non-western")) == [3]
    assert _ids(run(cards, "ete")) == [4]
    assert _ids(run(cards, "")) == []


def test_scope_and_facets(cards):
    assert _ids(run(cards, "thermal", only="title")) == [1]
    hits = run(cards, "thermal cities walks")
    assert set(_ids(hits.where(search.facet_filter(["domain==research", "unknown=x"])))) == {1, 3, 4}
    assert set(_ids(hits.where(search.facet_filter(["domain=RES"], collection="urb")))) == {3, 4}
    assert search.facets_in_domain(["domain==a", "year=1"], "b") == ["year=1", "domain==b"]


def test_stemmed_cards_match_inflections(cards):
    table = TextTable(cards, "id", ("title", "text"), (), stemmed=True)
    assert {r["id"] for r in bm25(table, query_phrases("wall storing")).collect()} == {1}


def test_bm25_value(cards):
    table = TextTable(cards, "id", ("title", "text"))
    score = {r["id"]: r["score"] for r in bm25(table, [["streets"]]).collect()}
    lengths = [8, 10, 6, 5]
    idf = math.log((4 - 1 + 0.5) / 1.5)
    expected = idf * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 6 / (sum(lengths) / 4)))
    assert score == {3: pytest.approx(expected)}


def test_postings_agree_with_text_scores(cards, spark, tmp_path):
    built = postings.build(cards, "id", "text")
    postings.write(built, str(tmp_path / "index"), buckets=4)
    stored = spark.read.parquet(str(tmp_path / "index"))
    assert stored.count() == built.count()
    lengths = postings.lengths(cards, "id", "text")
    plain = {r["id"]: round(r["score"], 9) for r in postings.bm25(built, lengths, "id", ["walls", "thermal", "walks"]).collect()}
    text = TextTable(cards, "id", ("text",))
    assert plain == {r["id"]: round(r["score"], 9) for r in bm25(text, [["walls"], ["thermal"], ["walks"]]).collect()}
    probed = postings.probe(stored, ["walls"])
    assert [r["id"] for r in probed.collect()] == [1]


def test_evidence_order(spark):
    notes = spark.createDataFrame([(1, "a", "", 3.0), (1, "b", "note", 1.0), (2, "c", "", 1.0)], "m int, k string, comment string, score double")
    top = {(r["m"], r["k"]): r["rank"] for r in search.top_annotations(notes, "m", "k", 3).collect()}
    assert top == {(1, "b"): 1, (1, "a"): 2, (2, "c"): 1}
    chunks = spark.createDataFrame([(1, "a", False, 1.0), (1, "b", True, 0.9), (1, "c", False, 1.5)], "m int, k string, emphasized boolean, score double")
    assert [r["k"] for r in search.top_chunks(chunks, "m", "k", 2).orderBy("rank").collect()] == ["c", "b"]


def test_content_first_limits_before_filter(spark):
    card = spark.createDataFrame([(5, 1)], "id int, rank int")
    found = search.content_candidates([spark.createDataFrame([(1,), (2,), (3,)], "id int"), spark.createDataFrame([(3,), (4,)], "id int")], "id", 2)
    assert [(r["id"], r["position"]) for r in found.orderBy("position").collect()] == [(1, 1), (2, 2), (3, 3), (4, 4)]
    allowed = spark.createDataFrame([(2,), (4,), (5,)], "id int")
    merged = search.append_content(card, found, allowed, "id")
    assert [(r["id"], r["ordinal"]) for r in merged.orderBy("ordinal").collect()] == [(5, 1), (2, 2), (4, 3)]


def test_rerank_prefers_commented_evidence(spark):
    ordered = spark.createDataFrame([(1, 1), (2, 2)], "id int, ordinal int")
    none = spark.createDataFrame([], "id int, emphasized boolean")
    notes = spark.createDataFrame([(2, "x"), (2, "y")], "id int, comment string")
    ranked = search.rerank(ordered, none, notes, spark.createDataFrame([], "id int"), "id")
    assert [r["id"] for r in ranked.orderBy("rank").collect()] == [2, 1]


def test_fallback_keeps_one_row_per_key(spark):
    a = spark.createDataFrame([(1, 2.0), (2, 1.0)], "id int, score double")
    b = spark.createDataFrame([(2,), (3,), (4,)], "id int")
    got = search.hits_then_fallback(a, b, "id", 3, [F.desc("score")], [F.asc("id")]).orderBy("rank").collect()
    assert [(r["id"], r["matched_by"]) for r in got] == [(1, "terms"), (2, "terms"), (3, "substring")]


def test_best_numbers_only_the_top(spark):
    rows = spark.range(50).withColumn("s", F.col("id") % 7)
    assert [r["id"] for r in best(rows, 3, F.desc("s"), F.asc("id")).orderBy("rank").collect()] == [6, 13, 20]
