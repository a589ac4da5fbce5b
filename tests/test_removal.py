from __future__ import annotations

import re

import pytest

from lectern.operators import removal


@pytest.mark.parametrize("share", [500_000, 5])
def test_a_task_holds_a_bounded_share_of_the_members(spark, monkeypatch, share):
    monkeypatch.setattr(removal, "SHARE", share)
    pairs = [(f"c{i}", f"m{i + k}") for i in range(30) for k in range(3)]
    members = spark.createDataFrame(pairs + pairs + [("c5", None), ("only", "m4"), ("only", "m4"), ("two", "m4"), ("two", "m9"), ("two", "m9")], "cluster_id string, material_id string")
    clusters = spark.createDataFrame([(c, None, "f") for c in {c for c, _ in pairs} | {"only", "two"}], "cluster_id string, wiki_path string, file string")
    empty = spark.createDataFrame([], "material_id string, domain string, collection string")
    stores = {"members": members, "clusters": clusters, "manifest": empty, "extracted": empty, "pages": spark.createDataFrame([], "path string")}
    asked = spark.createDataFrame([("m4",), ("m5",)], "material_id string")
    # the number of partitions differs between the two shares, the result doesn't
    hit, _ = removal._hit(stores, asked)
    # c3 holds m3 to m5 and c4 m4 to m6: one is left; c2 and c5 keep two
    assert {r["cluster_id"]: r["collapses"] for r in hit.collect()} == {"c2": False, "c3": True, "c4": True, "c5": False, "only": True, "two": True}
    runs = spark._jsparkSession.sharedState().statusStore().executionsList()
    plan = [p for p in (runs.apply(i).physicalPlanDescription() for i in range(runs.size())) if "/removal-hit-" in p and "InsertIntoHadoopFsRelationCommand" in p][-1]
    dealt = [int(n) for n in re.findall(r"hashpartitioning\(material_id#\d+, (\d+)\), REPARTITION_BY_NUM", plan)]
    assert dealt and min(dealt) >= members.count() / share
