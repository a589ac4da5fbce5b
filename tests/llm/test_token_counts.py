from __future__ import annotations

import random
import tracemalloc

import pytest

from lectern.llm import token_counts as C


@pytest.fixture(scope="module")
def scores():
    return C.piece_scores(C.vocabulary_path())


def viterbi(word: str, scores) -> int:
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        size = len(word[end - 1].encode("utf-8", "surrogatepass"))
        options = [(best[-1][0] + size * scores[""], -(best[-1][1] + size))]
        for start in range(end):
            if word[start:end] in scores:
                options.append((best[start][0] + scores[word[start:end]], -(best[start][1] + 1)))
        top = max(options)
        best.append((top[0], -top[1]))
    return best[-1][1]


def test_trie_counts_are_those_of_each_word_alone(scores, monkeypatch):
    rng = random.Random(1)
    letters = list("abcdeinrst") + ["é", "ß", "你", "🙂", "▁", "\x00", "ing", "tion"]
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 14))) for _ in range(800)]
    trie = C.Trie(scores, C.endings_of(scores))
    assert [trie.count(C.SPACE_MARK + w) for w in words] == [viterbi(C.SPACE_MARK + w, scores) for w in words]
    assert len(trie.best) < sum(len(w) + 1 for w in words)  # prefixes are shared
    text = " ".join(words)
    whole = C.Counter(C.vocabulary_path()).of(text)
    monkeypatch.setattr(C, "MOST_NODES", 50)
    monkeypatch.setattr(C, "MOST_WORDS", 3)
    counter = C.Counter(C.vocabulary_path())
    assert counter.of(text) == counter.of(text) == whole == (800, sum(viterbi(C.SPACE_MARK + w, scores) for w in words))


def test_rows(odd_documents, scores):
    found = C.counted(odd_documents).collect()
    assert len(found) == 11
    by_id = {r["doc_id"]: (r["n_pretokens"], r["n_tokens"]) for r in found}
    assert by_id[1] == by_id[2] == by_id[3] == (0, 0)
    assert by_id[4] == (3, sum(viterbi("▁" + w, scores) for w in ("123", "456", "!!")))
    assert C.counted(odd_documents.limit(0)).count() == 0


def test_very_long_words(scores):
    rng = random.Random(3)
    endings = C.endings_of(scores)
    word = "▁" + "".join(rng.choice(["a", "the", "你", "🙂", "ing", "\x01"]) for _ in range(900))
    assert C.count_alone(word, scores, endings) == C.Trie(scores, endings).count(word) == viterbi(word, scores)
    counter = C.Counter(C.vocabulary_path())
    tracemalloc.start()
    assert counter.of("ab1" * 700_000)[0] == 1
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20 and len(counter.trie.best) == 1 and not counter.known
