from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from conftest_llm import prose
from lectern.llm import packing as P


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.tokenizer_path())


def test_ids_are_those_of_the_library(library):
    rng = random.Random(4)
    alphabet = ["a", "A", "é", "É", "z", "'s", " ", "S", "'T", "0", "²", "½", "ª", "µ", "ß", "İ", "À", "_", "-", "!", "\n", "\t",
                "’", "—", "<|endoftext|>", "Σ", "ς", "Ж", "你", "́", "\x85", "\x1c", " ", "🙂", "the ", "ing"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 25))) for _ in range(1500)]
    want = [i for t in texts for i in library.encode(t, add_special_tokens=False).ids + [P.END]]
    for bound in (P.CACHED_WORDS, 5):
        tokens = P.Tokens(P.tokenizer_path(), bound)
        got = [tokens.of(texts[i:i + 50])[0] for i in range(0, len(texts), 50)]
        assert np.concatenate(got).tolist() == want


@pytest.mark.parametrize("dims,bits", [(2, 4), (3, 3), (4, 2)])
def test_hilbert_keys_are_a_walk_to_neighbours(dims, bits):
    side = 1 << bits
    cells = np.stack(np.meshgrid(*[np.arange(side)] * dims), axis=-1).reshape(-1, dims)
    keys = P.hilbert_keys(cells, bits)
    assert sorted(keys.tolist()) == list(range(side ** dims))
    walk = cells[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("total", [0, 1, 2047, 2048, 5000, 6144])
def test_tail_is_cut_into_powers_of_two(total):
    sizes = np.diff([total // 2048 * 2048, *P.tail_cuts(total)]).tolist()
    assert sum(sizes) == total % 2048 and all(s & (s - 1) == 0 for s in sizes) and sizes == sorted(sizes, reverse=True)


def check(pieces, docs, library, length):
    """Exact round trip: pieces of a document give its ids; sequences are gapless and full or a power of two."""
    want = sorted(str(library.encode(t or "", add_special_tokens=False).ids + [P.END]) for t in docs)
    by_place = {(p["sequence_id"], p["offset"]): p for p in pieces}
    assert len(by_place) == len(pieces)
    sizes = defaultdict(int)
    for (sequence, offset), p in sorted(by_place.items()):
        assert offset == sizes[sequence] and len(p["ids"]) == 4 * p["length"] > 0
        sizes[sequence] += p["length"]
    assert sorted(sizes) == list(range(len(sizes)))
    assert all(n == length or n & (n - 1) == 0 and n < length for n in sizes.values())
    got, open_ = [], []
    for _, p in sorted(by_place.items()):
        ids = np.frombuffer(p["ids"], "<u4").tolist()
        if p["start"] == 0:
            open_ = []
        assert p["start"] == len(open_)
        open_ += ids
        if len(open_) == p["doc_tokens"]:
            got.append(str(open_))
    assert sorted(got) == want


@pytest.mark.parametrize("length", [64, 2048])
def test_pieces_round_trip(documents, library, length):
    texts = [prose(i, 1 + 37 * i % 300) for i in range(40)] + ["", None] + [prose(3, 50)] * 5
    pieces = P.packed(documents(list(enumerate(texts))), length=length).collect()
    check(pieces, texts, library, length)


def test_similar_documents_are_neighbours(documents):
    rows = [(i, " ".join(random.Random(i).choices(["red", "green", "blue"] if i % 2 else ["eins", "zwei", "drei"], k=80)))
            for i in range(40)]
    order = [p["doc_id"] % 2 for p in sorted(P.packed(documents(rows)).collect(), key=lambda p: (p["sequence_id"], p["offset"]))]
    assert sum(a != b for a, b in zip(order, order[1:])) <= 5


def test_odd_rows(odd_documents, library):
    pieces = P.packed(odd_documents).collect()
    check(pieces, [r["text"] for r in odd_documents.collect()], library, 2048)
    assert P.packed(odd_documents.limit(0)).count() == 0


def test_checksum_of_the_query(spark, documents, library, tmp_path):
    documents([(1, "some words"), (2, None)]).write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"]: r for r in P.query(spark, str(tmp_path)).collect()}
    ids = library.encode("some words", add_special_tokens=False).ids + [1]
    assert found[1]["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
    assert found[2]["length"] == 1
