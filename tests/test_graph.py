from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from lectern.functions import figures
from lectern.operators import deltas, evidence, graph, incremental, overlap, related


def test_reference_resolution_stages(spark):
    index = spark.createDataFrame([
        ("m1", "whiteness", "whiteness"), ("m1", "White Wall", "white wall"), ("m1", "whit", "whit"),
        ("m2", "Glass", "glass"), ("m2", "stone", "stone")], "material_id string, concept_name string, concept_key string")
    refs = spark.createDataFrame([
        ("exact", "m2", "stones"), ("name", "m2", " GLASS "), ("prefix", "m2", "sto"), ("ambiguous", "m1", "white"),
        ("unknown", "m2", "wood"), ("elsewhere", "m3", "stone")], "ref_id string, material_id string, concept_name string")
    got = {r["ref_id"]: r["concept_key"] for r in deltas.resolve_references(refs, index).collect()}
    assert got == {"exact": "stone", "name": "glass", "prefix": "stone"}


def test_claims_stay_claimed_when_cluster_vanishes(spark):
    rows = spark.createDataFrame([
        ("a", 1, 1, "m1", "k"), ("b", 2, 2, "m1", "k"), ("b", 2, 3, "m2", "k"), ("b", 2, 4, "m3", "j")],
        "cluster_id string, cluster_pos int, src_pos int, material_id string, concept_key string")
    claims = deltas.first_claims(rows)
    assert {(r["material_id"], r["concept_key"]): r["cluster_id"] for r in claims.collect()}[("m1", "k")] == "a"
    assert {(r["material_id"], r["concept_key"]) for r in deltas.connected(claims).collect()} == {("m2", "k"), ("m3", "j")}


def test_running_number_crosses_ranges(spark):
    rows = spark.range(1000).select(F.when(F.col("id") < 900, "hot").otherwise("cold").alias("g"), F.col("id").alias("p"))
    got = deltas.running_number(rows, ["g"], "p", width=64).collect()
    assert all(r["number"] == (r["p"] + 1 if r["g"] == "hot" else r["p"] - 899) for r in got)


def test_bridge_eligibility(spark):
    rows = spark.createDataFrame([
        (1, 1, "d", "x"), (1, 2, "d", "y"), (2, 1, "d", "x"), (2, 3, "d", "x"), (3, 1, "d", "x"), (3, 3, "d", "x"), (3, 4, "d", "x"),
        (4, 1, "d", "x"), (4, 5, "e", "y"), (4, 6, "e", "z")], "bridge_id int, cluster_id int, domain string, collection string")
    assert {r["bridge_id"] for r in deltas.eligible_bridges(rows).collect()} == {1, 3}


def test_related_signals_exclude_the_seed(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (1, "b")], "material_id int, keyword string")
    got = related.shared_attribute(rows, 1, "keyword", "shared_keyword").collect()
    assert {(r["material_id"], r["value"]) for r in got} == {(2, "a"), (3, "b")}
    facets = spark.createDataFrame([(1, " Lisbon ", ""), (2, "lisbon", ""), (3, "", "x")], "material_id int, location string, scale string")
    got = related.shared_facets(facets, 1, ["location", "scale"]).collect()
    assert [(r["material_id"], r["facet"], r["value"]) for r in got] == [(2, "location", "Lisbon")]
    assert related.shared_facets(facets, 1, ["location", "scale"], folded=False).count() == 0


def test_relations_of_seeds(spark):
    edges = spark.createDataFrame([(1, "m"), (2, "m"), (3, "n"), (1, "n")], "cluster_id int, material_id string")
    seeds = spark.createDataFrame([(1,)], "cluster_id int")
    got = {(r["cluster_id"], r["related_cluster_id"], r["material_id"]) for r in graph.relations_of(edges, seeds).collect()}
    assert got == {(1, 2, "m"), (1, 3, "n")}


def test_change_plan(spark):
    manifest = spark.createDataFrame([("a", "h1", "i1"), ("b", "h2", "i2"), ("c", "h3", "i3"), ("d", "h4", "i4")], "path string, file_hash string, material_id string")
    snap = spark.createDataFrame([("a", "h1", "i1"), ("b", "h9", "i9"), ("moved", "h3", "i3"), ("new", "h7", "i7"), ("d", "h4", "i4")], "path string, file_hash string, material_id string")
    ignored = spark.createDataFrame([("h4",)], "file_hash string")
    got = {(r["action"], r["path"], r["material_id"]) for r in incremental.change_plan(manifest, snap, ignored).collect()}
    assert got == {("update", "b", "i9"), ("delete", "", "i2"), ("move", "moved", "i3"), ("add", "new", "i7"), ("delete", "", "i4")}
    assert incremental.change_plan(manifest, manifest, ignored.where("false")).count() == 0


def test_cascade_collapses_small_clusters(spark):
    rows = spark.createDataFrame([("c", "m1"), ("c", "m2"), ("d", "m2"), ("d", "m3"), ("d", "m4")], "cluster_id string, material_id string")
    left = incremental.cascade_delete(rows, spark.createDataFrame([("m1",)], "material_id string")).collect()
    assert {r["cluster_id"] for r in left} == {"d"} and len(left) == 3


def test_chunk_budget_paths(spark):
    few = spark.createDataFrame([("c", i, float(i)) for i in range(3)], "cluster_id string, material_id int, weight double")
    assert {r["chunk_limit"] for r in evidence.chunk_budget(few, 40, 4).collect()} == {4}
    mid = spark.createDataFrame([("c", i, float(i)) for i in range(15)], "cluster_id string, material_id int, weight double")
    got = {r["material_id"]: r["chunk_limit"] for r in evidence.chunk_budget(mid, 40, 4).collect()}
    assert sum(got.values()) == 40 and got[14] == 3 and got[0] == 2
    wide = spark.createDataFrame([("c", i, float(i)) for i in range(50)], "cluster_id string, material_id int, weight double")
    got = {r["material_id"]: r["chunk_limit"] for r in evidence.chunk_budget(wide, 40, 4).collect()}
    assert sum(got.values()) == 40 and got[9] == 0 and got[10] == 1


def _brute_overlap(chunks, notes, form):
    out = set()
    for m, p, cid, text in chunks:
        body = form(text)
        for m2, p2, aid, quote, kind in notes:
            span = form(quote)
            if (m, p) != (m2, p2) or kind not in ("highlight", "underline") or len(span) < 10:
                continue
            words = span.split()
            width = min(len(words), 6)
            windows = [" ".join(words[i:i + width]) for i in range(len(words) - width + 1)] if len(words) >= 4 else []
            if span in body or any(w in body for w in windows):
                out.add((m, cid, aid))
    return out


def test_overlap_matches_brute_force(spark):
    rng = random.Random(3)
    vocabulary = ["stone", "wall", "heat", "mass", "light", "brick", "tower", "ground"]
    sentence = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    chunks = [(f"m{i % 3}", 1 + i % 2, f"c{i}", sentence(40)) for i in range(30)]
    notes = []
    for i in range(60):
        m, p, _, body = chunks[rng.randrange(30)]
        words = body.split()
        at, size = rng.randrange(30), rng.choice([2, 3, 4, 5, 7, 9])
        quote = " ".join(words[at:at + size])
        quote = quote[rng.choice([0, 1]):] + rng.choice(["", " odd tail", "x"])
        notes.append((m, p, f"a{i}", quote, rng.choice(["highlight", "underline", "note"])))
    got = overlap.overlaps(
        spark.createDataFrame(chunks, "material_id string, page int, chunk_id string, text string"),
        spark.createDataFrame(notes, "material_id string, page int, annotation_id string, quoted_text string, type string"))
    found = {(r["material_id"], r["chunk_id"], r["annotation_id"]) for r in got.collect()}
    assert found == _brute_overlap(chunks, notes, lambda t: " ".join(t.split()).lower())
    assert found


def test_merged_regions_match_pairwise_merging(spark):
    rng = random.Random(5)
    rects = [(k, float(x), float(y), float(x + rng.randrange(5, 60)), float(y + rng.randrange(5, 60)))
             for k in (1, 2) for x, y in ((rng.randrange(900), rng.randrange(900)) for _ in range(60))]

    def brute(boxes):
        boxes = [[a - 20, b - 20, c + 20, d + 20] for a, b, c, d in boxes]
        changed = True
        while changed:
            changed = False
            for i in range(len(boxes)):
                for j in range(i + 1, len(boxes)):
                    p, q = boxes[i], boxes[j]
                    if not (p[2] < q[0] or q[2] < p[0] or p[3] < q[1] or q[3] < p[1]):
                        boxes[i] = [min(p[0], q[0]), min(p[1], q[1]), max(p[2], q[2]), max(p[3], q[3])]
                        del boxes[j]
                        changed = True
                        break
                if changed:
                    break
        return sorted(boxes)

    df = spark.createDataFrame(rects, "page int, x0 double, y0 double, x1 double, y1 double")
    got = figures.merged_regions(df, ["page"], salts=4).collect()
    for k in (1, 2):
        assert sorted([r["x0"], r["y0"], r["x1"], r["y1"]] for r in got if r["page"] == k) == brute([r[1:] for r in rects if r[0] == k])


def test_audit_targets(spark):
    clusters = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "cluster_id string, fingerprint string")
    reviews = spark.createDataFrame([("a", "1", "open"), ("b", "x", "open")], "cluster_id string, input_fingerprint string, status string")
    got = {r["cluster_id"]: r["reasons"] for r in deltas.audit_targets(clusters, reviews).collect()}
    assert got == {"b": "changed_since_last_audit,open_review", "c": "missing_review"}


def test_cluster_ids_are_never_cut(spark):
    numbers = [0, 1234567, 9_999_999, 12_345_678, 12_345_679, 20_000_000]
    rows = spark.createDataFrame([(n,) for n in numbers], "n long")
    ids = [r["i"] for r in rows.select(deltas.cluster_id(F.lit("s"), F.col("n")).alias("i")).collect()]
    assert len(set(ids)) == len(numbers) and ids[0] == "s__local_0000000" and ids[-1] == "s__local_20000000"


def test_every_artifact_phrase_marks_a_scan(spark):
    rows = spark.createDataFrame([(f"Una {p.upper()}.",) for p in figures.SCAN_ARTIFACT_PHRASES] + [("a drawing",)], "d string")
    box = F.array(*[F.lit(float(x)) for x in (0, 0, 10, 10)])
    found = rows.where(figures.deletable(F.lit("substantive"), F.lit("embedded"), box, F.col("d"))).count()
    assert found == len(figures.SCAN_ARTIFACT_PHRASES) == 48


def test_hashes_tell_null_from_text_and_fields_apart(spark):
    from lectern.functions.lists import canonical_hash

    rows = spark.createDataFrame([(None, "b"), ("null", "b"), ("a\u001fb", ""), ("a", "b\u001f"), ("", None)], "x string, y string")
    assert rows.select(canonical_hash(F.col("x"), F.col("y")).alias("h")).distinct().count() == 5


def test_overlap_shuffles_texts_and_finds_every_width(spark):
    rng = random.Random(8)
    words = ["ab", "abc", "bca", "cab", "lantern", "superstructure", "understructure"]
    chunks = [("m", 1, f"c{i}", " ".join(rng.choice(words) for _ in range(120))) for i in range(40)]
    chunks += [("m", None, "lost", chunks[0][3]), ("m", 1, "c0", chunks[1][3]), ("m", 1, "none", None)]
    notes = []
    for i in range(400):
        body = chunks[i % 40][3]
        at = rng.randrange(len(body) - 70)
        notes.append(("m", 1, f"a{i}", body[at:at + rng.choice([10, 11, 12, 15, 20, 30, 60])], "highlight"))
    notes += [("m", None, "lost", chunks[0][3], "highlight"), ("m", 1, "null", None, "highlight")]
    notes += [("m", 1, f"copy{i}", chunks[2][3], "underline") for i in range(30)]
    got = overlap.overlaps(
        spark.createDataFrame(chunks, "material_id string, page int, chunk_id string, text string"),
        spark.createDataFrame(notes, "material_id string, page int, annotation_id string, quoted_text string, type string"))
    found = [(r["material_id"], r["chunk_id"], r["annotation_id"]) for r in got.collect()]
    known = lambda rows: [(*r[:3], r[3] or "", *r[4:]) for r in rows if r[1] is not None]
    assert len(found) == len(set(found))
    assert set(found) == _brute_overlap(known(chunks), known(notes), lambda t: " ".join(re.sub(r"\b[a-z]\b", "", t).split()))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "inline" not in plan  # texts are shuffled; windows and positions are no rows


def test_concepts_are_cut_from_the_texts_once(spark, tmp_path):
    from lectern.plans import deltas

    spark.createDataFrame([(i, f"relation words\nthe library {i % 3}\nshelves", f"src{i % 2}") for i in range(12)], "doc_id long, text string, source string").write.parquet(
        str(tmp_path / "documents.parquet"))
    found = deltas.validated_clusters(spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "source#" in plan and "text#" not in plan, plan
    assert re.search(r"SortMergeJoin \[material_id#\d+L?, probe#\d+\]", plan), plan
    assert {r["cluster_id"]: r["materials"] for r in found.collect()} == {"src0": 6, "src1": 6}


def test_materials_of_clusters_are_picked_once(spark):
    from lectern.operators import graph_tables

    clusters = spark.createDataFrame([("c1", "d", "x", "One", "one", 0.5, "", 1), ("c2", "d", "x", "Two", "two", 0.5, "", 2)],
                                     "cluster_id string, domain string, collection string, canonical_name string, slug string, confidence double, wiki_path string, position long")
    sources = spark.createDataFrame([("c1", "m1", "high", 0.1, 1), ("c1", "m1", "low", 0.2, 2), ("c2", "m1", "low", 0.3, 3), ("c9", "m1", "low", 0.3, 4)],
                                    "cluster_id string, material_id string, relevance string, confidence double, position long")
    found = graph_tables.local_tables(clusters, spark.createDataFrame([("c1", "a")], "cluster_id string, alias string"), sources,
                                      spark.createDataFrame([("m1", "d", "x")], "material_id string, domain string, collection string"),
                                      spark.createDataFrame([("c1",)], "cluster_id string"))
    assert sorted((r["cluster_id"], r["material_id"], r["relevance"]) for r in found["cluster_materials"].collect()) == [("c1", "m1", "high"), ("c2", "m1", "low")]
    assert [tuple(r) for r in found["relations"].collect()] == [("c1", "c2", 1)]
    for name in ("clusters", "cluster_materials", "relations"):
        plan = found[name]._jdf.queryExecution().optimizedPlan().toString()
        assert "relevance" not in plan or "min_by" not in plan
        assert any("/held-" in f for f in found[name].inputFiles())
