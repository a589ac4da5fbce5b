from __future__ import annotations

import functools
import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from lectern.llm import alignment


@functools.cache
def libraries():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a_path, b_path = alignment.tokenizer_paths()
    a_lib, b_lib = Tokenizer.from_file(a_path), SentencePieceProcessor(model_file=b_path)
    a_lib.encode_special_tokens = True
    return a_lib, b_lib, alignment._Side(a_path).bytes


def plain(text):
    """Groups of one text: whole-text tokenisation and one cut at a time."""
    if not text:
        return []
    a_lib, b_lib, side = libraries()
    a = a_lib.encode(" " + text, add_special_tokens=False).ids
    b = b_lib.encode(text)
    pieces = [bytes([int(b_lib.id_to_piece(i)[3:5], 16)]) if b_lib.is_byte(i) else
              b_lib.id_to_piece(i).replace("▁", " ").encode() for i in b]
    raw = (" " + text).encode()
    if b"".join(side[i] for i in a) != raw or b"".join(pieces) != raw:
        return []
    groups, i, j, x, y = [([], [])], 0, 0, 0, 0
    while i < len(a):
        if x <= y:
            groups[-1][0].append(a[i])
            x, i = x + len(side[a[i]]), i + 1
        if y < x:
            while y < x:
                groups[-1][1].append(b[j])
                y, j = y + len(pieces[j]), j + 1
        if x == y:
            groups.append(([], []))
    return groups[:-1]


@pytest.fixture(scope="module")
def brute():
    memo = {}

    def run(texts):
        whole = [memo[t] if t in memo else memo.setdefault(t, plain(t)) for t in texts]
        held = Counter(p for groups in whole for p in {(a, b) for x, y in groups for a in x for b in y})
        most = defaultdict(int)
        for (a, _), n in held.items():
            most[a] = max(most[a], n)
        out = []
        for groups in whole:
            links = [(a, b) for x, y in groups for a in x for b in y]
            text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
            out.append((sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(links),
                        sum(held[p] == most[p[0]] for p in links), sum(held[p] for p in links),
                        hashlib.sha256(text.encode()).hexdigest() if text else ""))
        return out

    return run


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
FIXED = ["", None, " ", "  ", "a", "a ", " a", "a  b ", "a\n b\n\n  c\t d", "line one.\nLine two  \n end", "it's we're 12345 !!",
         "<|endoftext|> </s> <s> <0x41> ▁", "a▁b", "naïve café Straße 你好世界 🙂🙂 ①ﬁ", "x" * 3000, "\x1c a\x85 b\xa0 c  d",
         "日本語" * 400, "tab\t\t end", "a" + " " * 100 + "b", "\r\n \r\n x", "<|endoftext|>", "the the the the", "\x00 \x00"]


def test_equal_to_brute_force(documents, brute):
    rng = random.Random(5)
    alphabet = ["a", "the", " ", "  ", "\n", "'s", "é", "你", "🙂", "1", "ing", ".", "\t", "Z", "_", " ", "ß"]
    texts = FIXED + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 60))) for _ in range(300)]
    found = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in alignment.with_counts(
        documents(list(enumerate(texts))).repartition(5)).collect()}
    for i, want in enumerate(brute(texts)):
        assert found[i] == want, texts[i]


def test_groups_of_the_operator(documents):
    row = alignment.aligned(documents([(1, "Tokenizers disagree")])).first()
    assert hashlib.sha256(row["groups"].encode()).hexdigest() == alignment.with_counts(
        documents([(1, "Tokenizers disagree")])).first()["groups_sha256"]
    assert row["n_groups"] == row["groups"].count("|") == row["groups"].count(";") + 1


def test_lanes_give_the_same_cuts():
    rng = np.random.default_rng(3)
    sides = []
    for _ in range(2):
        ends = [np.unique(np.append(rng.integers(1, n, n // 2), n)) for n in (5_000, 40, 3_000, 2)]
        sides.append((np.concatenate(ends), np.array([len(e) for e in ends])))
    (ends_a, counts_a), (ends_b, counts_b) = sides
    whole, lanes = (alignment.lockstep(ends_a, counts_a, ends_b, counts_b, most) for most in (10**9, 100))
    assert all((x == y).all() for x, y in zip(whole, lanes))
    offset, want = 0, 0
    for k in range(4):
        a = ends_a[counts_a[:k].sum():counts_a[:k + 1].sum()]
        want += len(np.intersect1d(a, ends_b[counts_b[:k].sum():counts_b[:k + 1].sum()]))
    assert len(whole[0]) == want


def test_blocks_and_forgotten_chunks_change_nothing(documents, brute, monkeypatch):
    texts = [f"word{i} shared words here, and {i % 7} more" for i in range(200)] + ["shared"] * 50
    for name, value in (("BLOCK_PAIRS", 50), ("CACHED_CHARS", 300), ("LARGE_GROUP", 1)):
        monkeypatch.setattr(alignment, name, value)
    got = alignment.Aligner(*alignment.tokenizer_paths())
    want = brute(texts)
    for start in range(0, len(texts), 20):
        counts, groups, sizes, pairs, times = got.of(texts[start:start + 20])
        assert [tuple(c) for c in counts.T.tolist()] == [w[:4] for w in want[start:start + 20]]
        assert [hashlib.sha256(g).hexdigest() for g in groups] == [w[6] for w in want[start:start + 20]]
        assert times.sum() == counts[3].sum()


def test_very_long_word_and_odd_rows(documents, odd_documents):
    long = alignment.with_counts(documents([(1, "ab1" * 300_000)])).first()
    assert long["n_links"] >= long["n_groups"] > 0
    found = alignment.with_counts(odd_documents)
    assert found.count() == 11 and found.columns == ["doc_id", *COLUMNS]
    assert found.where("n_a = 0").count() == 2  # null and empty
    assert alignment.with_counts(odd_documents.limit(0)).count() == 0
