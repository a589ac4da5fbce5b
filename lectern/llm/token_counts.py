"""Token counts under a unigram segmentation, with a trie that shares the scores of common prefixes.

A text's pre-tokens are its words between white space, each behind the mark that stands for the space. The best
segmentation of a pre-token into vocabulary pieces maximises the sum of their log probabilities (ties: fewer pieces).
A forward score depends only on the characters read so far, so distinct pre-tokens go into a trie, a node holds the
best score and piece count of its prefix, and each is computed once however many pre-tokens pass through it. A
pre-token's terminal count is kept and added up for each occurrence.

The vocabulary is that of a public piece model; its pieces come in order of rank, and the model has no probabilities,
so piece of rank r gets the Zipf-Mandelbrot weight 1 / (r + `OFFSET`). A character in no piece costs its UTF-8 bytes,
each scored below every piece. Nothing is trained. The trie and the counts of a task start anew when they reach a
bound, and a pre-token of `LONG` characters or more takes twelve bytes a character and no nodes; results do not depend on that.

Defined results: null or empty text, and text of white space only, has 0 tokens; repeated rows give repeated results;
very long texts and words are counted whole. Only doc_id and text are read, so other columns can have any name. Empty
tables give no rows.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lectern.llm.common import slices, table

SPACE_MARK = "▁"
OFFSET = 2.7
MOST_NODES, MOST_WORDS = 700_000, 300_000
LONG = 2_000  # characters from which a pre-token is counted by the same recurrence without nodes that others could share


def piece_scores(path: str) -> dict[str, float]:
    """log probability of every piece; the empty key has that of one byte."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())
              if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
    total = math.log(sum(1 / (r + OFFSET) for r in range(len(pieces) + 256)))
    scores = {piece: -math.log(rank + OFFSET) - total for rank, piece in enumerate(pieces)}
    scores[""] = -math.log(len(pieces) + 256 + OFFSET) - total
    return scores


def endings_of(scores: dict[str, float]) -> set[str]:
    """All that a piece can end in."""
    return {piece[i:] for piece in scores for i in range(len(piece))}


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Trie:
    """Forward scores of prefixes. A node is a number; `step` leads from (node, character) to the next node."""

    def __init__(self, scores: dict[str, float], endings: set[str]) -> None:
        self.scores, self.byte, self.endings = scores, scores[""], endings
        self.step: dict[int, int] = {}
        self.best, self.pieces = [0.0], [0]

    def count(self, word: str) -> int:
        """Pieces of the best segmentation of a word."""
        step, best, pieces, scores, endings = self.step, self.best, self.pieces, self.scores, self.endings
        path, node = [0], 0
        for end, character in enumerate(word, start=1):
            key = node << 21 | ord(character)
            found = step.get(key)
            if found is None:
                high, few = -math.inf, 0
                if character not in scores:
                    size = len(character.encode("utf-8", "surrogatepass"))
                    high, few = best[node] + size * self.byte, pieces[node] + size
                for start in range(end - 1, -1, -1):
                    part = word[start:end]
                    if part not in endings:  # no piece ends like this, so none that is longer does
                        break
                    score = scores.get(part)
                    if score is not None:
                        before = path[start]
                        score += best[before]
                        if score > high or score == high and pieces[before] + 1 < few:
                            high, few = score, pieces[before] + 1
                found = step[key] = len(best)
                best.append(high)
                pieces.append(few)
            node = found
            path.append(node)
        return pieces[node]


def count_alone(word: str, scores: dict[str, float], endings: set[str]) -> int:
    """Trie.count() of one word that shares nothing."""
    best, pieces = array("d", [0.0]), array("i", [0])
    for end, character in enumerate(word, start=1):
        high, few = -math.inf, 0
        if character not in scores:
            size = len(character.encode("utf-8", "surrogatepass"))
            high, few = best[-1] + size * scores[""], pieces[-1] + size
        for start in range(end - 1, -1, -1):
            part = word[start:end]
            if part not in endings:
                break
            score = scores.get(part)
            if score is not None:
                score += best[start]
                if score > high or score == high and pieces[start] + 1 < few:
                    high, few = score, pieces[start] + 1
        best.append(high)
        pieces.append(few)
    return pieces[-1]


class Counter:
    """Token counts of texts."""

    def __init__(self, path: str) -> None:
        self.scores = piece_scores(path)
        self.known: dict[str, int] = {}
        self.endings = endings_of(self.scores)
        self.trie = Trie(self.scores, self.endings)

    def of(self, text: str | None) -> tuple[int, int]:
        """Number of pre-tokens and of tokens."""
        if not text:
            return 0, 0
        words = text.split()
        known = self.known
        for word in sorted(w for w in set(words) if w not in known):
            if len(self.trie.best) > MOST_NODES:
                self.trie = Trie(self.scores, self.endings)
            known[word] = self.trie.count(SPACE_MARK + word) if len(word) < LONG else count_alone(
                SPACE_MARK + word, self.scores, self.endings)
        total = sum(map(known.__getitem__, words))
        for word in {w for w in words if len(w) >= LONG}:
            del known[word]
        if len(known) > MOST_WORDS:
            known.clear()
        return len(words), total


_COUNTERS: dict[str, Counter] = {}  # of this worker process


def counted(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_pretokens, n_tokens."""
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _COUNTERS.get(path) or _COUNTERS.setdefault(path, Counter(path))
        for batch in (part for whole in batches for part in slices(whole)):
            both = np.array([counter.of(t) for t in batch.column(1).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(both[:, 0]), pa.array(both[:, 1])],
                                             ["doc_id", "n_pretokens", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_pretokens long, n_tokens long")


def query(spark, sf_dir: str) -> DataFrame:
    """Pre-tokens and tokens of every document."""
    return counted(table(spark, sf_dir, "documents"))
