from __future__ import annotations

import math

import numpy as np
import pytest

from lectern.llm import hard_negatives as hn

F = hn.F
SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows):
    kept = {}
    for i, v, label in rows:
        if i is None or label is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if i % 7 == 0 else label
        own = label, [math.floor(256 * float(np.float32(x))) for x in v]
        kept[i] = min(kept.get(i, own), own)
    out = []
    for a, (label, v) in kept.items():
        if a % 100:
            continue
        scores = sorted((-sum(x * y for x, y in zip(v, w)), i, other) for i, (other, w) in kept.items() if i != a and len(v) == len(w))
        for p, i, other in [s for s in scores if s[2] == label][:5]:
            hits = [(n, j) for n, j, o in scores if o != label and 80 * -p <= 100 * -n <= 100 * -p][:5]
            out += [(a, i, r + 1, j, -p, -n) for r, (n, j) in enumerate(hits)]
    return sorted(out)


def got(spark, rows, tmp_path):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    return sorted(tuple(r) for r in hn.query(spark, str(tmp_path)).collect())


def table_of(seed, n, dims, labels=10, scale=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dims))
    values = centres[rng.integers(0, 6, n)] + 0.5 * rng.normal(size=(n, dims))
    values *= scale / np.linalg.norm(values, axis=1)[:, None]
    return [(i, [float(x) for x in v], int(rng.integers(0, labels))) for i, v in enumerate(values)]


@pytest.mark.parametrize("dims, scale, block", [(8, 1.0, 1 << 20), (70, 1.0, 5_000), (130, 40.0, 50_000), (3, 30_000.0, 400)])
def test_equal_to_brute_force(spark, tmp_path, monkeypatch, dims, scale, block):
    monkeypatch.setattr(hn, "BLOCK_BYTES", block)
    monkeypatch.setattr(hn, "CELLS", 64)
    rows = table_of(dims, 420, dims, scale=scale)
    want = brute(rows)
    assert got(spark, rows, tmp_path) == want and len(want) > 10


def test_ties_copies_and_odd_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(hn, "BLOCK_BYTES", 300)
    rows = table_of(4, 200, 4, labels=3)
    rows += [(1000 + i, [0.5, 0.5, 0.0, 0.0], i % 3) for i in range(150)]  # ties
    rows += [(None, [1.0] * 4, 1), (501, None, 1), (502, [], 1), (503, [1.0, None, 0.0, 0.0], 1), (600, [float("nan")] * 4, 2),
             (700, [float("inf")] * 4, 2), (800, [0.0] * 4, 1), (900, [1.0, 0.0], 1), (901, [1.0, 0.0], 1), (902, [0.9, 0.0], 2),
             (1, [1.0, 0.0, 0.0, 0.0], None), (100, [0.9, 0.1, 0.0, 0.0], 1), (100, [0.9, 0.1, 0.0, 0.0], 1), (100, [0.1, 0.1, 0.9, 0.0], 0)]
    want = brute(rows)
    assert got(spark, rows, tmp_path) == want and any(w[0] == 900 for w in want)


def test_empty_table_and_clashing_names(spark, tmp_path):
    assert got(spark, [], tmp_path) == []
    names = ("id", "v", "dim", "block", "asked", "score", "rank", "raw", "r", "p")
    df = spark.createDataFrame(table_of(1, 210, 5), SCHEMA)
    args = (F.col("id") % 100 == 0, F.col("vec_id"), F.col("label"), F.col("embedding"))
    plain = sorted(tuple(r) for r in hn.mined(df, *args).collect())
    assert plain == sorted(tuple(r) for r in hn.mined(df.withColumns({n: F.lit("x") for n in names}), *args).collect())


def test_products_are_exact():
    rng = np.random.default_rng(9)
    for dims, top in ((1, 5), (64, 256), (65, 3000), (300, 2**20), (2, 2**29)):
        a, b = (rng.integers(-top, top + 1, (7, dims)).astype(np.float64) for _ in range(2))
        a[0], b[0] = top, -top
        whole_a, whole_b = (m.astype(np.int64).astype(object) for m in (a, b))
        bound = max((m**2).sum(axis=1).max() for m in (whole_a, whole_b))
        primes = hn.primes_for(bound)
        found = hn.products(hn.Residues(a, primes).parts, hn.Residues(b, primes).parts, primes)
        assert (found == whole_a @ whole_b.T).all()


def test_scores_beyond_a_long_are_an_error(spark, tmp_path):
    with pytest.raises(ValueError):
        got(spark, [(0, [1e30, 1.0], 1), (1, [1e30, 1.0], 1)], tmp_path)
