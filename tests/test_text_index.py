from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from lectern.operators import text_index
from lectern.operators.ranking import TextTable, bm25, query_phrases
from lectern.plans import indexes

WORDS = "the of licence licensing licensed hated hatedness relation relational café cafe one two".split()
ASKS = ("licensing hated", '"of the"', "the-of", "café one", '"the the"', "relational", "of", "missing", '"one two of"', "   ")


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(4)
    texts = [(i, *(" ".join(rng.choice(WORDS) for _ in range(rng.randrange(12))) or None for _ in range(3)), i % 3) for i in range(120)]
    return spark.createDataFrame(texts, "id long, title string, summary string, body string, kind int").repartition(3).cache()


@pytest.mark.parametrize("stemmed", [False, True])
def test_index_answers_like_a_scan(spark, rows, tmp_path, stemmed):
    table = TextTable(rows, "id", ("title", "summary", "body"), ("kind",), stemmed=stemmed)
    index = text_index.write(table, str(tmp_path / "index"))
    for ask in ASKS:
        for only in (None, "summary"):
            def found(df):
                return sorted((r["id"], r["kind"], round(r["score"], 9)) for r in df.collect())

            assert found(text_index.bm25(index, spark, query_phrases(ask), only)) == found(bm25(table, query_phrases(ask), only)), (ask, only)


def test_plan_reads_the_index_only(spark, rows, tmp_path):
    rows.write.parquet(str(tmp_path / "cards.parquet"))
    table = TextTable(spark.read.parquet(str(tmp_path / "cards.parquet")), "id", ("title", "body"))
    index = text_index.write(table, str(tmp_path / "index"))
    found = text_index.bm25(index, spark, [["the"]])
    assert found.count() > 0 and all("/index/" in f for f in found.inputFiles())
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "bucket#" in plan and "EqualTo(term,the)" in plan


def test_an_index_is_built_once_per_state_of_the_files(spark, rows, tmp_path):
    path = str(tmp_path / "cards.parquet")

    def built():
        return indexes.index_of(spark, "cards", TextTable(spark.read.parquet(path), "id", ("title",))).path

    rows.write.parquet(path)
    first = built()
    assert built() == first
    rows.where(F.col("id") < 50).write.mode("overwrite").parquet(path)
    assert built() != first


def test_empty_table(spark, rows, tmp_path):
    index = text_index.write(TextTable(rows.limit(0), "id", ("title",)), str(tmp_path / "index"))
    assert text_index.bm25(index, spark, [["the"]]).count() == 0


def test_building_shuffles_no_postings_and_empty_questions_build_nothing(spark, rows, tmp_path):
    rows.write.parquet(str(tmp_path / "cards.parquet"))
    table = TextTable(spark.read.parquet(str(tmp_path / "cards.parquet")), "id", ("title", "summary", "body"), ("kind",))
    built = dict(indexes._BUILT)
    assert indexes.search(spark, "unasked", table, query_phrases("   ")).count() == 0 and indexes._BUILT == built
    store, before = spark._jsc.sc().statusStore(), set()

    def written():
        none, empty = spark.sparkContext._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList()
        stages = store.stageList(None, False, False, none, empty)
        return {s.stageId(): s.shuffleWriteRecords() for s in (stages.apply(i) for i in range(stages.size()))}

    before = set(written())
    index = text_index.write(table, str(tmp_path / "index"))
    after = written()
    assert sum(n for stage, n in after.items() if stage not in before) < 100  # partial sums only; there are some 1,400 postings
    places = spark.read.schema(index.schema).parquet(f"{index.path}/postings")
    assert places.count() > 700 and places.where("places <> sort_array(places)").count() == 0
    assert places.count() == places.select("term", "id").distinct().count()


def test_postings_are_sorted_by_bucket_once(spark, rows, tmp_path):
    index = text_index.write(TextTable(rows, "id", ("title", "body")), str(tmp_path / "sorted"))
    runs = spark._jsparkSession.sharedState().statusStore().executionsList()
    plans = [runs.apply(i).physicalPlanDescription() for i in range(runs.size())]
    written = [p for p in plans if f"{index.path}/postings" in p and "MapInArrow" in p]
    written = [re.sub(r"#\d+", "", p) for p in written]
    assert len(written) == 1 and set(re.findall(r"^\(\d+\) Sort.*\n.*\nArguments: (\[.*?\])", written[0], re.M)) == {"[bucket ASC NULLS FIRST]"}


def test_words_are_grouped_some_rows_at_a_time(spark, rows, tmp_path, monkeypatch):
    batches = [b for b in rows.select("id", F.split("title", " ").alias("a"), F.split("body", " ").alias("b")).toArrow().to_batches()]
    whole = text_index._postings(2, True)(iter(batches))
    monkeypatch.setattr(text_index, "WORDS", 7)
    parts = list(text_index._postings(2, True)(iter(batches)))
    listed = lambda found: sorted(map(str, (r for b in found for r in b.to_pylist())))
    assert len(parts) > 50 and listed(parts) == listed(whole)


def test_more_text_than_a_task_takes_is_dealt(spark, rows, tmp_path, monkeypatch):
    table = TextTable(rows.coalesce(1), "id", ("title", "summary", "body"), ("kind",))
    assert text_index._dealt(table).rdd.getNumPartitions() == 1
    monkeypatch.setattr(text_index, "TASK_TEXT", 400)
    text = rows.agg(F.sum(F.octet_length(F.concat_ws("", "title", "summary", "body")))).first()[0]
    assert text_index._dealt(table).rdd.getNumPartitions() >= text / 400 > 10
    index = text_index.write(table, str(tmp_path / "dealt"))
    tasks = {re.search(r"part-(\d+)", f).group(1) for f in spark.read.parquet(f"{index.path}/postings").inputFiles()}
    assert len(tasks) > 10
    listed = lambda found: sorted((r["id"], r["kind"], round(r["score"], 9)) for r in found.collect())
    assert listed(text_index.bm25(index, spark, [["the"], ["one", "two"]])) == listed(bm25(table, [["the"], ["one", "two"]]))
