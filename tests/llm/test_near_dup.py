from __future__ import annotations

import random

import numpy as np
import pytest

from conftest_llm import prose
from lectern.llm import near_dup as N
from lectern.llm.components import components


def lcs(a, b) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, start=1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def exact(a: np.ndarray, b: np.ndarray) -> float:
    a, b = N.shingles(a).tolist(), N.shingles(b).tolist()
    n = lcs(a, b)
    return n / (len(a) + len(b) - n)


def edited(text: str, seed: int, edits: int) -> str:
    rng, words = random.Random(seed), text.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("repeats", [False, True])
def test_similarity_is_that_of_the_full_alignment(repeats):
    rng = random.Random(3)
    for trial in range(60):
        words = [str(rng.randrange(4 if repeats else 1000)) for _ in range(rng.randint(5, 60))]
        other = list(words)
        for _ in range(rng.randint(0, 3)):
            other[rng.randrange(len(other)):][:1] = [str(rng.randrange(1000))]
            if rng.random() < 0.5:
                other.insert(rng.randrange(len(other)), "x")
        a, b = N.word_hashes(words), N.word_hashes(other)
        want, got = exact(a, b), N.similarity(a, b)
        assert (want >= N.SIMILARITY) == (got >= N.SIMILARITY)
        if got:
            assert got == pytest.approx(want)


def test_sketches_mark_occurrences_and_order():
    once, twice = N.word_hashes("a b c d e".split()), N.word_hashes("a b c d e a b c d e".split())
    assert len(set(N.labelled(N.shingles(np.tile(once, 3))).tolist())) == 11
    assert (N.sketches(N.shingles(once)) != N.sketches(N.shingles(twice))).any()
    forward, backward = N.shingles(N.word_hashes(list("abcdefghijkl"))), N.shingles(N.word_hashes(list("ghijklabcdef")))
    assert (N.sketches(forward) != N.sketches(backward)).all()


def brute(rows) -> dict[int, int]:
    texts = {i: N.word_hashes(N.words_of(t)) for i, t in rows if t}
    parent = {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in texts:
        for b in texts:
            if a < b and len(texts[a]) and len(texts[b]) and exact(texts[a], texts[b]) >= N.SIMILARITY:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: root(i) for i in texts}


@pytest.mark.parametrize("small", [32, 2])
def test_classes_match_brute_force(documents, monkeypatch, small):
    """With small = 2 every group goes the way of large buckets."""
    monkeypatch.setattr(N, "SMALL", small)
    rows = [(i, prose(i, 60)) for i in range(20)]
    rows += [(100 + i, edited(prose(0, 60), i, i % 4)) for i in range(14)]
    rows += [(200, prose(1, 60)), (201, prose(1, 60).upper() + "!")]
    chain = prose(50, 80)
    for i in range(5):
        rows.append((300 + i, chain))
        chain = edited(chain, i, 1)
    found = {r["doc_id"]: r["class_id"] for r in N.near_classes(documents(rows)).collect()}
    assert found == brute(rows)


def shared_bands(*texts: str) -> np.ndarray:
    keys = [N.sketches(N.shingles(N.word_hashes(t.split()))) for t in texts]
    return np.flatnonzero(np.all([k == keys[0] for k in keys], axis=0))


def test_one_shared_sketch_in_a_large_bucket_is_enough(documents, monkeypatch):
    """14 words and their first 12 (similarity 0.8) that share one sketch only, in a bucket led by another text."""
    monkeypatch.setattr(N, "SMALL", 2)
    rows = []
    for seed in range(100_000):
        longer = [f"w{seed}x{j}" for j in range(14)]
        x, y = " ".join(longer[:12]), " ".join(longer)
        bands = shared_bands(x, y)
        if len(bands) != 1:
            continue
        leads = (" ".join([*longer[:12], *(f"v{k}x{j}" for j in range(4))]) for k in range(1000))
        z = next(z for z in leads if bands[0] in shared_bands(x, y, z))
        rows += [(10 * len(rows) + i, t) for i, t in enumerate((z, x, y))]
        if len(rows) == 12:
            break
    found = {r["doc_id"]: r["class_id"] for r in N.near_classes(documents(rows)).collect()}
    assert found == brute(rows) and len(set(found.values())) == 8


def test_similarity_of_exactly_the_limit_with_shifted_shingles():
    for n in (4, 8, 28, 52):  # shingles of the shorter text
        words = N.word_hashes([f"w{j}" for j in range(n + n // 4 + 4)])
        for start in range(n // 4 + 1):
            assert N.similarity(words[start:start + n + 4], words) == pytest.approx(0.8)


@pytest.mark.parametrize("small", [32, 1])
def test_no_pair_of_short_texts_is_missed(documents, monkeypatch, small):
    """Every place of a left out word, in texts of up to 13 words that are just similar enough, or just not."""
    monkeypatch.setattr(N, "SMALL", small)
    rows = []
    for k in range(400):
        words = [f"w{k}x{j}" for j in range(8 + k % 6)]
        other = words[:-1] if k % 2 else words[1:]
        if len(words) == 13:
            other = [*words[1:], "odd"] if k % 2 else [*words[:-1], "odd"]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
    found = {r["doc_id"]: r["class_id"] for r in N.near_classes(documents(rows)).collect()}
    alike = {a: exact(N.word_hashes(rows[a][1].split()), N.word_hashes(rows[a + 1][1].split())) >= N.SIMILARITY
             for a in range(0, 800, 2)}
    assert 300 < sum(alike.values()) < 400
    assert found == {i: i - i % 2 if alike[i - i % 2] else i for i in range(800)}


def test_odd_rows(odd_documents):
    found = N.near_classes(odd_documents).collect()
    classes = {(r["doc_id"], r["class_id"]) for r in found}
    assert len(found) == 11
    assert classes == {(1, 1), (2, 2), (3, 3), (4, 4), (None, None), (5, 5), (6, 5), (7, 7), (8, 8), (9, 9)}
    kept = N.one_of_each(odd_documents)
    assert kept.columns == odd_documents.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["1", "2", "3", "4", "5", "7", "8", "9", "None"])
    assert N.near_classes(odd_documents.limit(0)).count() == 0


def test_wordless_texts_are_copies_only_if_identical(documents):
    found = {r["doc_id"]: r["class_id"] for r in N.near_classes(documents(
        [(1, "!!"), (2, "!!"), (3, "??"), (4, "two words"), (5, "Two, words")])).collect()}
    assert found == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4}


def test_components_of_paths_and_cycles(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100), (7, 7), (None, 3)]
    found = {r["vertex"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
