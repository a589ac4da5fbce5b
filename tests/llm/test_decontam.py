from __future__ import annotations

import random

import numpy as np

from conftest_llm import prose
from lectern.llm import decontam as D


def distance(a, b) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, start=1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, start=1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_edit_distance_floats_its_end():
    rng = random.Random(1)
    for _ in range(100):
        item = [rng.randrange(8) for _ in range(rng.randint(3, 12))]
        window = [rng.randrange(8) for _ in range(rng.randint(1, 14))]
        want = min(distance(item, window[:n]) for n in range(len(window) + 1))
        got, end = D.edit_distance(np.array(item, np.uint64), np.array(window, np.uint64), 12)
        assert got == want and (got > 12 or distance(item, window[:end]) == want)
        assert D.edit_distance(np.array(item, np.uint64), np.array(window, np.uint64), 1)[0] == min(want, 2)


def brute(docs, items) -> dict[tuple[int, int], int]:
    found = {}
    for d, text in docs:
        words = D.words_of(text or "")
        for i, item in items:
            own = D.words_of(item)
            most = int((1 - D.SIMILARITY) * len(own) + 1e-9)
            for start in range(len(words)):
                best = min(distance(own, words[start:start + n]) for n in range(len(own) - most, len(own) + most + 1))
                if best <= most:
                    found[d, i] = min(found.get((d, i), 99), best)
    return found


def test_finds_what_brute_force_finds(spark, documents):
    items = [(i, prose(i, n)) for i, n in enumerate((8, 12, 20, 30, 45))]
    rng, docs = random.Random(5), [(100, prose(99, 200)), (101, None), (102, "")]
    for d in range(24):
        own = items[d % 5][1].split()
        for _ in range(d % 3):
            place = rng.randrange(len(own))
            own[place:place + rng.randint(0, 1)] = ["odd"] * rng.randint(0, 1)
        docs.append((d, f"{prose(200 + d, 30)} {' '.join(own).upper()}. {prose(300 + d, 30)}"))
    bench = spark.createDataFrame([*items, (50, None), (51, "too short"), (52, items[2][1])], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r["distance"] for r in D.contaminated(documents(docs), bench).collect()}
    want = brute(docs, [*items, (52, items[2][1])])
    assert len(want) >= 24
    assert {k: v for k, v in found.items() if v <= 1} == {k: v for k, v in want.items() if v <= 1}
    assert set(found) <= set(want)
    kept = {r["doc_id"] for r in D.clean(documents(docs), bench).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in found}


def test_blocks_of_items_give_the_same(spark, documents):
    bench = spark.createDataFrame([(i, prose(i, 15)) for i in range(12)], "item_id long, text string")
    docs = documents([(i, prose(i, 15)) for i in range(6)])
    blocks = D.item_blocks(bench, 40)
    assert len(blocks) > 3 and sum(b.count() for b in blocks) == 12
    assert D.contaminated(docs, bench).count() == 6


def test_odd_rows(spark, odd_documents):
    bench = spark.createDataFrame([(1, prose(1, 60)), (None, prose(2, 20))], "item_id long, text string").withColumn(
        "label", D.F.lit("x"))
    found = D.contaminated(odd_documents, bench).collect()
    assert sorted((str(r["doc_id"]), r["item_id"]) for r in found) == [("5", 1), ("5", 1), ("6", 1), ("7", None)]
    assert D.clean(odd_documents, bench).columns == odd_documents.columns
    assert D.contaminated(odd_documents.limit(0), bench).count() == 0
    assert D.contaminated(odd_documents, bench.limit(0)).count() == 0
    assert D.clean(odd_documents, bench.limit(0)).count() == 11


def nearest(item, words) -> int:
    """Least edit distance of the item from any run of words, by the full table."""
    row = [0] * (len(words) + 1)
    for i, x in enumerate(item, start=1):
        before, row[0] = row[0], i
        for j, y in enumerate(words, start=1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return min(row)


def test_recall_at_every_distance_up_to_the_limit(spark, documents):
    """Passages with as many edits as similarity 0.8 allows, of every kind, also at the ends of a document."""
    items = [(i, prose(i, n)) for i, n in enumerate((8, 9, 14, 15, 23, 37, 59))]
    rng, docs = random.Random(9), []
    for d in range(280):
        own = items[d % 7][1].split()
        for _ in range(min(d // 7, len(own) // 5 + 4)):
            place = rng.randrange(len(own))
            own[place:place + rng.randint(0, 1)] = [f"odd{rng.randrange(10**6)}"] * rng.randint(0, 1)
        docs.append((d, " ".join([prose(400 + d, 6) * (d % 3 > 0), *own, prose(800 + d, 6) * (d % 2)])))
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r["distance"] for r in D.contaminated(documents(docs), bench).collect()}
    words = {i: D.words_of(t) for i, t in items}
    every = {(d, i): nearest(words[i], D.words_of(t)) for d, t in docs for i in words}
    want = {(d, i): n for (d, i), n in every.items() if n <= int(0.2 * len(words[i]) + 1e-9)}
    assert {0, 10, 11} <= {n for (_, i), n in want.items() if i == 6} and len(want) > 100
    assert set(found) <= set(want) and all(found[k] == n for k, n in want.items() if n == 0)
    for i in words:
        own = [k for k in want if k[1] == i]
        assert sum(found.get(k) == want[k] for k in own) >= 0.9 * len(own), i


def test_recall_at_the_limit_by_length():
    """Edited copies in long texts, all with the largest accepted number of edits, against the exact distance."""
    rng = np.random.default_rng(8)
    for n in (5, 7, 11, 16, 31, 60, 120):
        items = [(i, [f"w{i}x{j}" for j in range(n)]) for i in range(60)]
        classes, texts, want = D.classes_of(items), [], 0
        for _, own in items:
            for _ in range(int(0.2 * n + 1e-9)):
                kind, place = rng.integers(3), int(rng.integers(len(own)))
                own = own[:place] + [f"odd{rng.integers(10**9)}"] * int(kind < 2) + own[place + (kind != 1):]
            texts.append(" ".join([f"u{k}" for k in rng.integers(0, 10**6, 50)] + own + [f"v{k}" for k in rng.integers(0, 10**6, 50)]))
            want += 1
        found = {(m[0], m[1]) for m in D.matches_in(classes, texts)}
        assert len(found & {(i, i) for i in range(60)}) >= 0.95 * want, n


def test_items_of_few_words(spark, documents):
    """One rule for all lengths: under five words no edit is within 0.2 of them, from five to nine one is."""
    items = [(n, " ".join(f"w{n}x{j}" for j in range(n))) for n in range(1, 8)] + [(0, "?!")]
    docs = [(n, f"{prose(n, 9)} {t.upper()}, {prose(50 + n, 9)} {t}") for n, t in items if n]
    docs += [(10 + n, f"{prose(n, 9)} {t.rsplit(' ', 1)[0]} odd") for n, t in items if n > 1] + [(20, items[6][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {tuple(r) for r in D.contaminated(documents(docs), bench).collect()}
    exact = {(n, n, 9, n, 0, 1.0) for n in range(1, 8)} | {(20, 7, 0, 7, 0, 1.0)}
    assert exact <= found
    assert {(d, i, distance) for d, i, _, _, distance, _ in found - exact} <= {(10 + n, n, 1) for n in (5, 6, 7)}
    assert len(found - exact) >= 2
