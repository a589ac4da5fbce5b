from __future__ import annotations

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lectern.functions import words
from lectern.functions.text import lines, word_tokens
from lectern.functions.words import char_classes, cutter, longest_of_lines
from lectern.operators import blocks, text_index
from lectern.operators.ranking import TextTable, bm25, query_phrases

WORDS = "the of licence licensing licensed hated hatedness relation relational café cafe one two ΟΔΟΣ ǅ".split()
ASKS = ("licensing hated", '"of the"', "café one", '"the the"', "missing", "οδος")
ODD = [*"abz09 _-.,İIıΣσςßŒœÀàéÉǿǽǢȐё́中文①Ⅷ²½’“—​ \t\U0001d400\U00010400😀\U000e0100", "é", "ẞ", "ǅ", "\n", "\n", "\r\n", "\r"]


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randrange(40))) for _ in range(3000)] + ["", None, "a", "\n", "x퟿y"]
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string").repartition(3).cache()


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(4)
    texts = [(i, *(" ".join(rng.choice(WORDS) for _ in range(rng.randrange(12))) or None for _ in range(3)), i % 3) for i in range(400)]
    return spark.createDataFrame(texts, "id long, title string, summary string, body string, kind int").repartition(3).cache()


@pytest.fixture
def small(monkeypatch):
    for module, name, value in ((text_index, "TASK_TEXT", 8000), (blocks, "GROUP_TEXT", 900), (blocks, "STEP", 5)):
        monkeypatch.setattr(module, name, value)


def found(df):
    return sorted((str(sorted(r.asDict().items() - {("score", r["score"])})), round(r["score"], 9)) for r in df.collect())


def test_words_are_those_of_the_expression(spark, odd):
    got = odd.select(word_tokens(F.col("text")).alias("w"), F.lower(F.coalesce("text", F.lit(""))).alias("l")).toArrow()
    want, low = got.column("w").combine_chunks(), got.column("l").combine_chunks()
    cut = cutter(char_classes(spark))
    whole = cut(low)
    assert whole.words.to_pylist() == want.flatten().to_pylist() and whole.per_text.tolist() == want.value_lengths().to_pylist()
    assert cut(low.slice(700, 9)).words.to_pylist() == want.slice(700, 9).flatten().to_pylist()
    assert cut(low.slice(0, 0)).words.to_pylist() == cut(pa.array(["", ""])).words.to_pylist() == []


@pytest.mark.parametrize("slice", [words.SLICE, 50])
def test_longest_words_of_lines(spark, odd, monkeypatch, slice):
    monkeypatch.setattr(words, "SLICE", slice)
    by_line = F.transform(lines(F.col("text")), lambda line: F.aggregate(
        word_tokens(line), F.lit(""), lambda a, w: F.when(F.length(w) > F.length(a), w).otherwise(a)))
    both = odd.select(F.filter(by_line, lambda w: w != "").alias("a"), longest_of_lines(F.col("text"), char_classes(spark)).alias("b"))
    assert both.where("not (a <=> b)").count() == 0 and both.where("size(a) > 1").count() > 1000


@pytest.mark.parametrize("stemmed", [False, True])
def test_packed_index_answers_like_a_scan(spark, rows, tmp_path, small, stemmed):
    table = TextTable(rows, "id", ("title", "summary", "body"), ("kind",), stemmed=stemmed)
    index = text_index.write(table, str(tmp_path / "index"))
    assert index.packed
    for ask, only in [*((a, None) for a in ASKS), ("licensing hated", "summary"), ('"of the"', "summary")]:
        phrases = query_phrases(ask)
        assert found(text_index.bm25(index, spark, phrases, only)) == found(bm25(table, phrases, only)), (ask, only)


def test_packed_index_keeps_what_repeated_and_null_keys_give(spark, rows, tmp_path, monkeypatch):
    twice = rows.unionByName(rows.where("id < 50")).withColumn("id", F.when(F.col("id") != 9, F.col("id")).cast("string"))
    for carry in (("kind", "title"), ()):
        table = TextTable(twice, "id", ("title", "body"), carry)
        plain = text_index.write(table, str(tmp_path / f"plain{len(carry)}"))
        with monkeypatch.context() as less:
            less.setattr(text_index, "TASK_TEXT", 8000)
            packed = text_index.write(table, str(tmp_path / f"packed{len(carry)}"))
        assert packed.packed and not plain.packed
        for ask in ("the one", '"of the"'):
            assert found(text_index.bm25(packed, spark, query_phrases(ask))) == found(text_index.bm25(plain, spark, query_phrases(ask)))


def test_postings_of_a_large_table_are_no_rows(spark, rows, tmp_path, monkeypatch):
    monkeypatch.setattr(text_index, "TASK_TEXT", 8000)
    index = text_index.write(TextTable(rows, "id", ("title", "body"), ("kind",)), str(tmp_path / "index"))
    stored = spark.read.schema(index.schema).parquet(f"{index.path}/postings")
    tasks = text_index._dealt(TextTable(rows, "id", ("title", "body")), None, text_index.PACKED).rdd.getNumPartitions()
    assert stored.where("bucket = -1").count() == 400
    assert 0 < stored.where("bucket >= 0").count() <= tasks * index.packed < 400  # a row a posting before: some 3,500


def test_costly_rows_are_derived_once(spark, rows, tmp_path, small):
    counted = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def costly(text):
        counted.add(1)
        return text

    table = TextTable(rows.select("id", costly("body").alias("body")), "id", ("body",), ("body",), derived=True)
    index = text_index.write(table, str(tmp_path / "index"))
    assert text_index.bm25(index, spark, [["the"]]).count() > 0 and counted.value == 400


def test_an_index_of_texts_without_words(spark, tmp_path, small):
    empty = spark.range(200).select("id", F.lit("...").alias("text"))
    index = text_index.write(TextTable(empty, "id", ("text",)), str(tmp_path / "index"))
    assert index.packed and text_index.bm25(index, spark, [["the"]]).count() == 0


def test_texts_are_cut_some_at_a_time():
    texts = pa.array(["a" * 30, "", "b" * 200, None, "c" * 9, "d" * 90])
    assert words.slices(texts, 100) == [(0, 3), (3, 6)] and words.slices(texts.slice(0, 2), 100) == [(0, 2)] and words.slices(texts.slice(0, 0), 1) == []
    assert words.slices(texts, 10) == [(0, 1), (1, 3), (3, 6)]


def test_rerank_evidence_finds_each_sources_hits_once(spark, tmp_path):
    from lectern.plans.search import rerank_evidence

    folder = str(tmp_path)
    texts = [(i, "en", "src", f"inhe mente {i}\n" + "reer word " * (i % 40)) for i in range(60)]
    turns = [(i, 1, "user" if i % 2 else "assistant", "the inhe mente") for i in range(0, 60, 3)]
    pages = [(i, "<p>reer inhe</p>") for i in range(0, 60, 7)]
    for name, rows, schema in (
            ("documents", texts, "doc_id long, lang string, source string, text string"), ("conversations", turns, "conv_id long, turn long, role string, text string"),
            ("pages", pages, "page_id long, html string"), ("labels", [(i, 1, 0) for i in range(0, 60, 2)], "doc_id long, quality int, toxic int")):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    found = rerank_evidence(spark, folder)
    rows = found.orderBy("rank").collect()
    assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1)) and len(rows) >= 20
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") < 20  # only those of the cards' search; all five sources' before
