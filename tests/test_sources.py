from __future__ import annotations

import json

import pytest
from pyspark.errors import ParseException
from pyspark.sql import functions as F

from lectern import schemas
from lectern.sources import paths, readers, writers
from lectern.streaming.changes import resume, watch_library


def _library(root):
    files = {
        "Research/energy/a.PDF": b"one", "practice/b.md": b"# H\n\ntext", "practice/previos/c.pdf": b"old",
        "other/scans/d.png": b"img", "Research/e.xyz": b"no", "top.txt": b"bad \xff bytes\r\nnext"}
    for name, content in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)


def test_scan_and_text(spark, tmp_path):
    _library(tmp_path)
    rows = {r["relative_path"]: r for r in readers.scan_library(spark, str(tmp_path)).drop("content").collect()}
    assert set(rows) == {"Research/energy/a.PDF", "practice/b.md", "other/scans/d.png", "top.txt"}
    assert rows["Research/energy/a.PDF"]["domain"] == "research" and rows["Research/energy/a.PDF"]["collection"] == "energy"
    assert rows["practice/b.md"]["collection"] == "_general"
    assert rows["other/scans/d.png"]["file_type"] == "scanned_document" and rows["other/scans/d.png"]["collection"] == "other"
    text = readers.read_text(readers.scan_library(spark, str(tmp_path)).where("file_type = 'text'")).first()
    assert text["text"] == "bad � bytes\nnext" and "non-utf8" in text["warning"]
    assert paths.extension_list([" .PDF", "pdf", ""]) == ("pdf",)


def test_markdown_sections(value):
    md = "intro\n# One\nbody\n```\n# not\n```\n## Two  \nlast\n### Three"
    got = value(readers.markdown_sections, md)
    assert [(s["heading"], s["body"]) for s in got] == [
        ("", "intro"), ("One", "# One\nbody\n```\n# not\n```"), ("Two", "## Two  \nlast\n### Three")]


def test_tolerant_jsonl_and_manifest(spark, tmp_path):
    assert readers.read_manifest(spark, str(tmp_path / "none.jsonl")).count() == 0
    lines = [json.dumps({"material_id": "m1", "file_hash": "a"}), "{broken", "", json.dumps({"material_id": "m1", "file_hash": "b"}), json.dumps({"material_id": "m2", "file_hash": "c"})]
    (tmp_path / "m.jsonl").write_text("\n".join(lines))
    rows = {r["material_id"]: r["file_hash"] for r in readers.read_manifest(spark, str(tmp_path / "m.jsonl")).collect()}
    assert rows == {"m1": "b", "m2": "c"}
    writers.write_manifest(readers.read_manifest(spark, str(tmp_path / "m.jsonl")), str(tmp_path / "out"))
    assert readers.read_manifest(spark, str(tmp_path / "out")).count() == 2


def test_artifacts_and_cluster_scope(spark, tmp_path):
    folder = tmp_path / "extracted" / "m7"
    folder.mkdir(parents=True)
    (folder / "chunks.jsonl").write_text(json.dumps({"chunk_id": "c1", "text": "x"}) + "\n")
    row = readers.read_artifacts(spark, str(tmp_path), "chunks.jsonl", schemas.CHUNK).first()
    assert (row["material_id"], row["chunk_id"]) == ("m7", "c1")
    folder = tmp_path / "derived" / "collections" / "research__energy"
    folder.mkdir(parents=True)
    (folder / "local_concept_clusters.jsonl").write_text(json.dumps({"cluster_id": "k", "canonical_name": "N"}) + "\n")
    row = readers.read_local_clusters(spark, str(tmp_path), schemas.CLUSTER).first()
    assert (row["domain"], row["collection"]) == ("research", "energy")


def test_injected_parser(spark, tmp_path):
    _library(tmp_path)
    files = readers.scan_library(spark, str(tmp_path))
    parser = lambda path, content: [{"material_id": path.rsplit("/", 1)[-1], "table_id": "t", "headers": ["h"], "rows": [[str(len(content))]]}]
    got = {r["material_id"]: r["rows"] for r in readers.parse_with(files, parser, schemas.TABLE).collect()}
    assert got["a.PDF"] == [["3"]] and len(got) == 4


def test_publish_keeps_the_last_version_until_a_new_one_is_whole(spark, tmp_path):
    target = str(tmp_path / "table")
    with pytest.raises(FileNotFoundError):
        writers.published(spark, target)
    writers.publish(spark.range(3), target)
    writers.publish(spark.range(5), target)
    assert writers.published(spark, target).count() == 5
    broken = spark.range(4).select(F.raise_error(F.lit("no")).alias("id"))
    with pytest.raises(Exception, match="no"):
        writers.publish(broken, target)
    assert writers.published(spark, target).count() == 5


def test_read_only_sql_refuses_statements(spark):
    assert readers.read_only_sql(spark, "WITH a AS (SELECT * FROM {t}) SELECT count(*) AS n FROM a;", t=spark.range(4)).first()["n"] == 4
    for statement in ("DROP TABLE x", "INSERT INTO x VALUES (1)", "SET a=b", "CREATE TABLE x AS SELECT 1",
                      "WITH a AS (SELECT 1) INSERT INTO x SELECT * FROM a"):
        with pytest.raises(ParseException):
            readers.read_only_sql(spark, statement)


def test_pages_and_json(spark, tmp_path):
    pages = spark.createDataFrame([("wiki-a", "# A\nbody"), ("wiki-b", "# B")], "path string, content string")
    writers.write_pages(pages, str(tmp_path / "pages"))
    assert "# A\nbody" in next((tmp_path / "pages" / "path=wiki-a").glob("*.txt")).read_text()
    assert writers.as_json(spark.createDataFrame([(1, "x")], "a int, b string")).first()["json"] == '{"a":1,"b":"x"}'
    ignored = spark.createDataFrame([("h", "p")], "file_hash string, path string")
    assert writers.append_ignored(ignored, ignored).count() == 1


def test_sheets_are_whole_unless_capped(spark):
    rows = spark.createDataFrame([("m", "s", i, ["a", "b", "c"]) for i in range(1, 6)], "material_id string, sheet string, row int, cells array<string>")
    whole = readers.capped_sheet(rows).collect()
    assert len(whole) == 5 and not any(r["truncated_rows"] or r["truncated_columns"] or len(r["cells"]) != 3 for r in whole)
    got = readers.capped_sheet(rows, 3, 2).collect()
    assert len(got) == 3 and all(r["truncated_rows"] and r["truncated_columns"] and len(r["cells"]) == 2 for r in got)


def test_watcher_plans_each_arrival(spark, tmp_path):
    root = tmp_path / "library"
    _library(root)
    manifest = spark.createDataFrame([("gone.pdf", "h", "i")], "path string, file_hash string, material_id string")
    ignored = spark.createDataFrame([], "file_hash string")

    def run():
        watch_library(spark, str(root), lambda: manifest, lambda: ignored, str(tmp_path / "plans"), str(tmp_path / "ck")).awaitTermination(120)

    run()
    plan = spark.read.parquet(str(tmp_path / "plans"))
    assert plan.where("action = 'add'").count() == 4 and plan.where("action = 'delete'").first()["material_id"] == "i"
    (root / "practice" / "new.pdf").write_bytes(b"fresh")
    run()
    plan = spark.read.parquet(str(tmp_path / "plans"))
    assert {r["path"] for r in plan.where("batch = 1 AND action = 'add'").collect()} >= {"practice/new.pdf"}


def test_resume_skips_done(spark):
    wanted = spark.range(5)
    assert {r["id"] for r in resume(spark.range(3), wanted, "id").collect()} == {3, 4}
    assert wanted.where(F.col("id") >= 0).count() == 5


def test_publish_all_commits_every_table_or_none(spark, tmp_path):
    target = str(tmp_path / "graph")
    old = {"a": spark.range(2), "b": spark.range(3)}
    writers.publish_all(old, target)
    broken = spark.range(3).select(F.raise_error(F.lit("stop")).cast("long").alias("id"))
    with pytest.raises(Exception, match="stop"):
        writers.publish_all({"a": spark.range(9), "b": broken}, target)
    found = writers.published_all(spark, target, ["a", "b"])
    assert found["a"].count() == 2 and found["b"].count() == 3
    writers.publish_all({"a": spark.range(7), "b": spark.range(8)}, target)
    assert [found["a"].count(), writers.published_all(spark, target, ["b"])["b"].count()] == [2, 8]


def test_version_numbers_are_taken_once(spark, tmp_path, monkeypatch):
    target = str(tmp_path / "table")
    writers.publish(spark.range(1), target)
    real, calls = writers._numbers, []

    def stale(fs, log):  # the first look misses an entry that another publisher has just made
        calls.append(1)
        return [] if len(calls) == 1 else real(fs, log)

    monkeypatch.setattr(writers, "_numbers", stale)
    writers.publish(spark.range(4), target)
    assert writers.published(spark, target).count() == 4
    assert sorted(p.name for p in (tmp_path / "table" / "log").iterdir() if not p.name.startswith(".")) == ["000000000001", "000000000002"]
    (tmp_path / "table" / "log" / "000000000003").touch()  # begun, and never written
    assert writers.published(spark, target).count() == 4
    writers.publish(spark.range(6), target)
    assert writers.published(spark, target).count() == 6
    monkeypatch.setattr(writers, "KEPT", 1)
    writers.publish(spark.range(7), target)
    assert writers.published(spark, target).count() == 7 and len([p for p in (tmp_path / "table" / "log").iterdir() if p.name.isdigit()]) == 2
