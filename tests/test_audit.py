from __future__ import annotations

import random

from lectern.operators import audit

SCHEMA = "scope string, proposal long, material_id string, concept_key string, retained boolean"


def in_order(rows):
    held, out = set(), {}
    for proposal in sorted({(r[0], r[1]) for r in rows}):
        own = [r for r in rows if r[:2] == proposal]
        won = {(r[0], r[2], r[3]) for r in own if not r[4]} - held
        if len({m for _, m, _ in won} | {r[2] for r in own if r[4]}) >= 2:
            held |= won
            out[proposal] = len(won) + len({r[2:4] for r in own if r[4]})
        else:
            out[proposal] = None
    return out


def decided(spark, rows):
    decisions, held = audit.accepted(spark.createDataFrame(rows, SCHEMA))
    counts = {(r["scope"], r["proposal"]): r["count"] for r in held.groupBy("scope", "proposal").count().collect()}
    return {(r["scope"], r["proposal"]): counts[r["scope"], r["proposal"]] if r["accepted"] else None for r in decisions.collect()}


def test_refused_proposals_give_their_claims_back(spark):
    rows = [("s", 1, "a", "k", False), ("s", 1, "b", "k", False), ("s", 2, "a", "k", False), ("s", 2, "c", "k", False),
            ("s", 3, "c", "k", False), ("s", 3, "d", "k", False), ("t", 1, "a", "k", False), ("t", 2, "a", "k", False), ("t", 2, "z", "k", True)]
    assert decided(spark, rows) == in_order(rows) == {("s", 1): 2, ("s", 2): None, ("s", 3): 2, ("t", 1): None, ("t", 2): 2}


def test_equal_to_one_after_the_other(spark):
    rng = random.Random(6)
    rows = sorted({(f"s{rng.randrange(3)}", rng.randrange(25), f"m{rng.randrange(9)}", f"k{rng.randrange(3)}", rng.random() < 0.1) for _ in range(300)})
    found = decided(spark, rows)
    assert found == in_order(rows) and None in found.values()


def test_nothing_proposed(spark):
    decisions, held = audit.accepted(spark.createDataFrame([], SCHEMA))
    assert decisions.count() == held.count() == 0
