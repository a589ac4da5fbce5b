from __future__ import annotations

import random
import re

from conftest_llm import prose
from lectern.llm import licenses as L

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(str.maketrans(L.UPPER, L.LOWER)))


def base(text):
    own, starts, labels = words(text), [], set()
    for label, phrase in L.PHRASES:
        size = len(phrase.split())
        for i in range(len(own)):
            if own[i:i + size] == phrase.split():
                starts.append(i)
                labels.add(label)
    return len(own), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def test_base_places_match_brute_force(documents):
    rng = random.Random(3)
    parts = ["under", "the", "MIT", "License", "Apache", "Version", "2", "CC", "BY-NC", "cc", "by", "nc", "É", "x.", "İ"]
    texts = [" ".join(rng.choice(parts) for _ in range(80)) for _ in range(60)]
    texts += ["under the MIT license " * 30, "Released UNDER the-mit_license", "cc", "cc by", "", None, "cc by nc", "ünder the mit license"]
    found = {r["doc_id"]: r for r in L.scanned(documents(list(enumerate(texts)))).collect()}
    for i, text in enumerate(texts):
        r = found[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == base(text), text
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))


def test_templates_by_diagonals(documents):
    notice = dict(L.TEMPLATES)
    mit = notice["mit"]
    changed = mit.replace("of charge", "of any charge").replace("obtaining a copy", "that gets a copy")
    rows = [(1, f"{prose(1, 40)} {mit} {prose(2, 40)}"), (2, f"{prose(3, 40)} {changed}"), (3, " ".join(mit.split()[:12])),
            (4, "This work is licensed under the GNU General Public License, version 3."),
            (5, "Licensed under the Apache License, Version 2.0."), (6, prose(5, 200)),
            (7, f"{mit} {prose(6, 10)} {notice['bsd']}"), (8, "licensed under the GNU General Public License version 2")]
    found = {r["doc_id"]: r for r in L.scanned(documents(rows)).collect()}
    labels = {i: r["labels"] for i, r in found.items()}
    assert labels == {1: "mit", 2: "mit", 3: "", 4: "gpl-3", 5: "apache-2", 6: "", 7: "bsd,mit", 8: "gpl-2"}
    assert found[1]["spans"] == f"mit:40:{40 + len(words(mit))}" and found[1]["score"] == 1 and found[1]["n_base"] == 0
    assert L.COVERAGE <= found[2]["score"] < 1 and found[6]["score"] == 0 and found[5]["score"] == 1


def test_odd_rows(odd_documents):
    found = L.scanned(odd_documents).collect()
    assert len(found) == 11 and all(0 <= r["score"] <= 1 for r in found)
    assert {r["doc_id"]: r["n_words"] for r in found}[1] == 0
    assert L.scanned(odd_documents.limit(0)).count() == 0
