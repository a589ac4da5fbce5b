from __future__ import annotations

from lectern.operators import projects


def run(spark, *entries):
    rows = [("p", i, e.get("kind", "merge"), e.get("actor", "cli"), e.get("stage"), e.get("confidence"), e.get("lists"),
             e.get("field"), e.get("position"), e.get("text")) for i, e in enumerate(entries)]
    outcomes, states = projects.fold_log(spark.createDataFrame(rows, projects.LOG), 4)
    return [r["reason"] for r in outcomes.orderBy("seq").collect()], states.first()


def test_merge_keeps_what_is_not_named_and_refuses_in_order(spark):
    reasons, last = run(
        spark, {"stage": "tender", "lists": {"risks_or_blockers": ["a"], "unknown": ["x"]}}, {"actor": "lint", "stage": "nowhere"},
        {"stage": "lead"}, {"stage": "lead", "lists": {"repair_actions": ["why"]}}, {"confidence": 1.5}, {"confidence": 0.5},
        {"lists": {"next_focus": [" A  b"], "main_objectives": ["a B"]}}, {"stage": "somewhere"})
    assert [bool(r) for r in reasons] == [False, True, True, False, True, False, True, True]
    assert reasons[1].startswith("updated_by") and reasons[2].startswith("backwards")
    assert reasons[6] == "'a b' appears in both main_objectives and next_focus"
    assert (last["stage"], last["confidence"], last["revision"]) == ("lead", 0.5, 3)
    assert last["lists"] == {"risks_or_blockers": ["a"], "repair_actions": ["why"]}


def test_list_edits_and_resolution(spark):
    edit = {"field": "next_focus", "actor": "human"}
    reasons, last = run(
        spark, {**edit, "kind": "add", "text": " one "}, {**edit, "kind": "add", "text": "Two  words"}, {**edit, "kind": "add", "text": " "},
        {**edit, "kind": "update", "position": 0, "text": "uno"}, {**edit, "kind": "update", "position": 9, "text": "x"},
        {"kind": "resolve", "text": "two WORDS"}, {"kind": "resolve", "text": "two words"}, {"kind": "resolve"},
        {"kind": "add", "field": "stage", "text": "x"}, {**edit, "kind": "delete", "position": 0})
    assert [bool(r) for r in reasons] == [False, False, True, False, True, False, True, True, True, False]
    assert last["lists"] == {} and last["revision"] == 5


def test_projects_do_not_mix_and_slices_change_nothing(spark):
    rows = [(f"p{i % 3}", i, "add", "cli", None, None, None, "decisions", None, f"t{i}") for i in range(150)]
    rows += [("hot", i, ("add", "delete", "update")[i % 3], "cli", None, None, None, "decisions", 0, f"t{i}") for i in range(100)]
    log = spark.createDataFrame(rows, projects.LOG)
    one, many = (projects.fold_log(log, size) for size in (1000, 7))
    for a, b in zip(one, many):
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    found = {r["project_id"]: r for r in many[1].collect()}
    assert {found[f"p{k}"]["revision"] for k in range(3)} == {50} and found["p1"]["lists"]["decisions"][:2] == ["t1", "t4"]
    empty = projects.fold_log(spark.createDataFrame([], projects.LOG))
    assert empty[0].count() == empty[1].count() == 0


def sections(spark, *entries):
    rows = [("p", e.get("section", "s"), i, e.get("actor", "cli"), e.get("body", "b"), e.get("revision", 1), e.get("replaces", ""),
             f"t{i}", e.get("protected"), e.get("why"), e.get("prior"), e.get("confidence")) for i, e in enumerate(entries)]
    return [r["reason"].split(":")[0] for r in projects.section_log(spark.createDataFrame(rows, projects.SECTION_LOG)).orderBy("seq").collect()]


def test_sections_compare_and_set(spark):
    stale = "stale section update"
    assert sections(spark, {}, {}, {"revision": 2, "replaces": "t0"}, {"revision": 2, "replaces": "t0"}, {"revision": 4, "replaces": "t2"},
                    {"revision": 3, "replaces": "t2"}) == ["", stale, "", stale, "section revision must be 3", ""]
    assert sections(spark, {"section": " "}, {"section": "a/b"}, {"body": " "}, {"actor": "lint"}, {"confidence": 2.0}, {}) == [
        "section_id is required", "section_id must be a slug, not a path", "section body is required", "updated_by must be one of",
        "section s confidence must be between 0 and 1", ""]


def test_protected_sections_need_a_reason(spark):
    follow = {"actor": "reflection", "revision": 2, "replaces": "t0"}
    need = "reflection overwrite of protected section requires "
    assert sections(spark, {"actor": "human"}, follow, {**follow, "why": "x"}, {**follow, "why": "x", "prior": True},
                    {"actor": "reflection", "revision": 3, "replaces": "t3"}) == [
        "", need + "justification", need + "references_prior_body=true", "", need + "justification"]
    assert sections(spark, {}, follow, {"actor": "cli", "protected": True, "revision": 3, "replaces": "t1"},
                    {**follow, "revision": 4, "replaces": "t2"}) == ["", "", "", need + "justification"]


def test_long_chain_of_revisions(spark):
    entries = [{"revision": i + 1, "replaces": f"t{i - 1}" if i else ""} for i in range(70)]
    assert set(sections(spark, *entries)) == {""}


def test_notes(spark):
    rows = [("append", "cli", None, "risk", "a"), ("append", "cli", None, "strategy", "a"), ("append", "human", None, "strategy", "a"),
            ("append", "cli", None, "risk", " "), ("edit", "cli", "note-0001", None, "b"), ("status", "cli", "note-0001", "deleted", None),
            ("edit", "cli", "note-0001", None, "c"), ("status", "cli", "note-0002", "deleted", None), ("status", "cli", "note-0002", "open", None),
            ("edit", "cli", "note-0002", None, "d"), ("edit", "hermes", "note-0002", None, "d"), ("edit", "cli", "note-0003", None, "d"),
            ("append", "cli", None, "gossip", "a"), ("status", "cli", "note-0001", "open", None), ("edit", "cli", "note-0001", None, "e")]
    log = spark.createDataFrame([("p", i, *r) for i, r in enumerate(rows)], projects.NOTE_LOG)
    found = projects.note_log(log).orderBy("seq").collect()
    assert [bool(r["reason"]) for r in found] == [False, True, False, True, False, False, True, True, True, True, False, True, True, False, False]
    assert [r["note_id"] for r in found[:4]] == ["note-0001", None, "note-0002", None] and found[6]["status"] == "deleted"


def test_list_edits_return_the_whole_list_after_each(spark, tmp_path):
    from lectern.plans import registry

    registry.load_all()
    kinds = ["signup", "signup", "click", "signup", "purchase", "view", "signup"]
    rows = [(seq, 1, kind) for seq, kind in enumerate(kinds, 1)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string").write.parquet(str(tmp_path / "events.parquet"))
    found = registry.QUERIES["project_list_edits"](spark, str(tmp_path)).orderBy("seq").collect()
    assert [r["items"] for r in found] == [
        "Task  1", "Task  1|Task  2", "Task  1|Task  2", "Task  1|Task  2|Task  4", "Task  1|Task  4", "Task  1|Task  4",
        "Task  1|Task  4|Task  1"]
    log = spark.createDataFrame([("p", i, "add", "cli", None, None, None, "decisions", None, f"t{i}") for i in range(9)], projects.LOG)
    lists = [r["items"] for r in projects.fold_log(log, 4, listing=True)[0].orderBy("seq").collect()]
    assert lists == [[f"t{i}" for i in range(n + 1)] for n in range(9)]
