from __future__ import annotations

import random
import re

import numpy as np
import pytest

import corpus_pipeline
from conftest_llm import prose
from lectern.llm import decontam, near_dup
from test_pii import base


@pytest.fixture(scope="module")
def folder(spark, documents, tmp_path_factory):
    rng = random.Random(9)
    rows = [(i, prose(i, 60 + i), "en") for i in range(60)]
    rows += [(100 + i, " ".join(w if rng.random() > 0.01 else "edit" for w in prose(i, 60 + i).split()), "en") for i in range(10)]
    rows += [(200, prose(1, 61), "en"), (201, None, "en"), (202, "12 34", "en"), (203, prose(70, 40) + " me@host.org", "en"),
             (204, f"{prose(71, 30)} {prose(500, 20)} {prose(72, 30)}", "en"), (None, prose(73, 50), "en")]
    path = str(tmp_path_factory.mktemp("tables"))
    documents(rows).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, prose(500, 20)), (2, prose(501, 30))], "item_id long, text string").write.parquet(
        f"{path}/benchmark.parquet")
    return path


def test_stages_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, folder), name)
        assert docs.columns == columns
        now = {r["doc_id"]: r["text"] for r in docs.collect()}
        if name == "language_id":
            want = {i: t for i, t in kept.items() if t and re.search("[a-z]", t)}
        elif name == "near_dedup":
            own = {i: near_dup.word_hashes(near_dup.words_of(t)) for i, t in kept.items()}
            want = {i: t for i, t in kept.items() if i is None or not any(
                j is not None and j < i and near_dup.similarity(own[i], own[j]) >= near_dup.SIMILARITY for j in own)}
        elif name == "decontamination":
            items = [decontam.words_of(prose(500, 20)), decontam.words_of(prose(501, 30))]
            want = {i: t for i, t in kept.items() if not any(" ".join(w) in " ".join(decontam.words_of(t)) for w in items)}
        else:
            want = {i: t if not base(t) else t.replace("me@host.org", "<EMAIL>") for i, t in kept.items()}
            assert not any(base(t) for t in now.values())
        assert now == want, name
        kept = now
    assert 200 not in kept and 204 not in kept and None in kept and kept[203].endswith("<EMAIL>")


def test_run_packs_what_was_kept(spark, folder):
    from tokenizers import Tokenizer

    from lectern.llm.packing import tokenizer_path

    library = Tokenizer.from_file(tokenizer_path())
    pieces = corpus_pipeline.run(spark, folder).collect()
    ids = {}
    for p in sorted(pieces, key=lambda p: p["start"]):
        ids.setdefault(p["doc_id"], []).extend(np.frombuffer(p["ids"], "<u4").tolist())
    assert ids[5] == library.encode(prose(5, 65), add_special_tokens=False).ids + [1]
    assert {len(v) for v in ids.values()} == {p["doc_tokens"] for p in pieces}


def test_stages_on_odd_and_empty_rows(spark, folder, odd_documents):
    for docs in (odd_documents, odd_documents.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            found = stage(spark, docs, folder)
            assert found.count() >= 0
            assert name == "packing" or found.columns == docs.columns


def test_entry_offers_the_queries():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)] == [1] * 10
