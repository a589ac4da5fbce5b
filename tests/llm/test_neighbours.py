from __future__ import annotations

import numpy as np
import pytest

from lectern.llm import neighbours as A


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in rows],
                                 "vec_id long, embedding array<float>")


def brute(rows, asked, k):
    out = {}
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if v is not None and i is not None and len(v)
            and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    for q, own in good:
        if q not in asked:
            continue
        scored = sorted((-float((own * v).sum() / (np.sqrt((v * v).sum()) * np.sqrt((own * own).sum()))), i)
                        for i, v in good if i != q and len(v) == len(own))
        out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def results(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        assert r["rank"] == len(out.setdefault(r["query_id"], [])) + 1
        out[r["query_id"]].append((r["vec_id"], r["score"]))
    return out


@pytest.mark.parametrize("blocks", [20_000, 150])
def test_recall_and_scores(spark, monkeypatch, blocks):
    monkeypatch.setattr(A, "BLOCK_BYTES", 8 * 24 * blocks)
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=24)) for i in range(600)]
    df = frame(spark, rows)
    found = results(A.nearest(df, df.where("vec_id % 30 = 0")))
    want = brute(rows, set(range(0, 600, 30)), 5)
    assert set(found) == set(want) and all(len(v) == 5 for v in found.values())
    hits = sum(len({i for i, _ in found[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 5 * len(want)
    scores = {(q, i): s for q, v in brute(rows, set(want), 600).items() for i, s in v}
    assert all(abs(scores[q, i] - s) < 1e-12 for q, v in found.items() for i, s in v)


def test_odd_vectors_ties_and_few_candidates(spark):
    rows = [(0, [1, 0]), (1, [1, 0]), (2, [2, 0]), (3, [0, 1]), (4, None), (5, []), (6, [0, 0]), (7, [1, None]),
            (8, [float("nan"), 1]), (9, [float("inf"), 1]), (10, [1, 1, 1]), (None, [1, 0]), (50, [1, 2, 3]), (3, [0, 1])]
    df = frame(spark, rows).withColumns({"id": A.F.lit(1), "v": A.F.lit(2), "dim": A.F.lit(3), "score": A.F.lit(4)})
    found = results(A.nearest(df, df.where("vec_id in (0, 4, 6, 7, 8, 50)")))
    assert [i for i, _ in found[0]] == [1, 2, 3] and [i for i, _ in found[50]] == [10]
    assert set(found) == {0, 50}
    assert A.nearest(df.limit(0), df.limit(0)).count() == 0
    assert A.nearest(df, df.limit(0)).count() == 0


def test_many_equal_vectors(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(400)] + [(1000, [3.0, 2.0, 1.0])]
    df = frame(spark, rows)
    found = results(A.nearest(df, df.where("vec_id in (0, 50, 1000)")))
    assert [i for i, _ in found[0]] == [1, 2, 3, 4, 5] and [i for i, _ in found[50]] == [0, 1, 2, 3, 4]
    assert [i for i, _ in found[1000]] == [0, 1, 2, 3, 4]


def test_index_returns_every_code_within_the_radius():
    rng = np.random.default_rng(2)
    codes = rng.integers(0, 256, (500, 8), dtype=np.uint8)
    codes[:50] = codes[0] ^ (rng.random((50, 8)) < 0.2).astype(np.uint8)
    index = A.Index(codes)
    for radius in (0, 5, 20, 40):
        distance = np.array([sum(bin(int(x)).count("1") for x in row ^ codes[0]) for row in codes])
        assert set(index.within(codes[0], radius, 0)) == set(np.flatnonzero(distance <= radius))
    assert len(index.within(codes[60], 0, 9)) >= 9
