from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from lectern.llm import lang_id

PARTS = {"aa": ["ba", "na", "ka", "ri"], "bb": ["sch", "ein", "ung", "ter"]}


def speech(lang: str, seed: int, n: int = 40) -> str:
    rng = random.Random(f"{lang}{seed}")
    return " ".join("".join(rng.choices(PARTS[lang], k=rng.randint(1, 3))) for _ in range(n))


def by_hand(grams: dict[str, dict[str, int]], word: str, lang: str, alphabet: int) -> float:
    """Interpolated Kneser-Ney straight from its definition."""
    levels = {lang_id.ORDER: Counter(grams[lang])}
    for k in range(lang_id.ORDER - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])

    def probability(gram: str) -> float:
        if not gram:
            return 1 / alphabet
        counts, context = levels[len(gram)], gram[:-1]
        own = {g: n for g, n in counts.items() if g[:-1] == context}
        if not own:
            return probability(gram[1:])
        once, twice = sum(n == 1 for n in counts.values()), sum(n == 2 for n in counts.values())
        d = min(0.95, max(0.1, once / (once + 2 * twice))) if once + twice else 0.5
        total = sum(own.values())
        lower = probability(gram[1:])
        seen = max(own[gram] - d, 0) / total if gram in own else 0
        return seen + d * len(own) / total * lower

    padded = lang_id.PAD + word + "\0"
    return sum(math.log2(probability(padded[i:i + lang_id.ORDER])) for i in range(len(word) + 1))


def test_scores_follow_the_definition():
    counts: dict[str, Counter] = {lang: Counter() for lang in PARTS}
    for lang in PARTS:
        for word in speech(lang, 0).split():
            padded = lang_id.PAD + word + "\0"
            for i in range(len(word) + 1):
                counts[lang][padded[i:i + lang_id.ORDER]] += 1
    model = lang_id.build_model(pd.DataFrame([(l, g, n) for l, c in counts.items() for g, n in c.items()],
                                             columns=["lang", "gram", "n"]))
    words = ["bana", "schein", "xyz", "kariungba", "é"]
    found = lang_id.word_scores(model, words)
    for i, word in enumerate(words):
        for l, lang in enumerate(model.languages):
            assert abs(found[i, l] - by_hand(counts, word, lang, model.alphabet)) < 1e-3


def test_predictions_and_rejection(documents):
    rows = [(i, speech(lang, i), lang) for i, lang in enumerate(["aa", "bb"] * 100)]
    rows += [(900, speech("aa", 5) + " " + speech("bb", 6), None), (901, "qxz wvq zzqx qqxw vwz " * 20, None),
             (902, None, "aa"), (903, "12 !?", None)]
    docs = documents(rows)
    model = lang_id.fit(docs, ~lang_id.held_out())
    found = {r["doc_id"]: r for r in lang_id.identify(docs, model).collect()}
    assert all(found[i]["lang_pred"] == lang for i, _, lang in rows[:200])
    assert not any(found[i]["rejected"] for i in range(200))
    assert not found[900]["rejected"] and found[901]["rejected"]
    assert found[902]["lang_pred"] == found[903]["lang_pred"] == "und"
    assert found[902]["score"] == 0 and found[902]["rejected"]
    kept = {r["doc_id"] for r in lang_id.known(docs, model).collect()}
    assert kept == {*range(200), 900}


def test_held_out_rows_and_texts_without_label_teach_nothing(documents):
    docs = documents([(i, speech("aa", i), "aa") for i in range(50)])
    fifth = docs.where(lang_id.held_out()).select("doc_id").collect()
    assert fifth and lang_id.fit(docs.where(lang_id.held_out()), ~lang_id.held_out()) is None
    assert {r["lang_pred"] for r in lang_id.identify(docs, None).collect()} == {"und"}


def test_odd_rows(odd_documents):
    model = lang_id.fit(odd_documents, ~lang_id.held_out())
    found = lang_id.identify(odd_documents, model)
    assert found.count() == 11 and found.where("score not between 0 and 1").count() == 0
    assert lang_id.known(odd_documents, model).columns == odd_documents.columns
    empty = odd_documents.limit(0)
    assert lang_id.identify(empty, model).count() == 0 and lang_id.fit(empty, F.lit(True)) is None


def test_long_words_are_whole_and_cache_is_bounded(monkeypatch):
    assert [len(w) for w in lang_id.words_of("a" * 100)] == [100]
    model = lang_id.build_model(pd.DataFrame({"lang": ["x"], "gram": [lang_id.PAD + "a"], "n": [1]}))
    plain = lang_id.Scorer(model).score(["ab cd", "ef gh"])
    monkeypatch.setattr(lang_id, "CACHED_WORDS", 1)
    scorer = lang_id.Scorer(model)
    for i, text in enumerate(["ab cd", "ef gh"]):
        assert np.allclose(scorer.score([text])[0][0], plain[0][i])
