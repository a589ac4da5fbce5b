"""English suffix stripping after Porter (1980), for the stemmed card index."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# Suffix rules (suffix, replacement) of steps 2, 3 and 4.
STEP_2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"),
    ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"),
    ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
)
STEP_3 = (
    ("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""),
    ("ness", ""),
)
STEP_4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou",
    "ism", "ate", "iti", "ous", "ive", "ize",
)


def _shape(stem: str) -> str:
    """Letters as v (vowel) or c (consonant); y after a consonant is a vowel."""
    shape = ""
    for letter in stem:
        vowel = letter in "aeiou" or (letter == "y" and shape.endswith("c"))
        shape += "v" if vowel else "c"
    return shape


def _measure(stem: str) -> int:
    return _shape(stem).count("vc")


def _double_consonant(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _short_end(word: str) -> bool:
    return _shape(word).endswith("cvc") and word[-1] not in "wxy"


def _replace_longest(word: str, rules, minimum: int) -> str:
    for suffix, new in sorted(rules, key=lambda r: -len(r[0])):
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            return stem + new if _measure(stem) > minimum else word
    return word


def _plurals(word: str) -> str:
    if word.endswith("sses") or word.endswith("ies"):
        return word[:-2]
    if word.endswith("s") and not word.endswith("ss"):
        return word[:-1]
    return word


def _past_and_progressive(word: str) -> str:
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    for suffix in ("ed", "ing"):
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            if "v" not in _shape(stem):
                return word
            if stem.endswith(("at", "bl", "iz")):
                return stem + "e"
            if _double_consonant(stem) and stem[-1] not in "lsz":
                return stem[:-1]
            return stem + "e" if _measure(stem) == 1 and _short_end(stem) else stem
    return word


def _drop_ending(word: str) -> str:
    for suffix in sorted(STEP_4, key=len, reverse=True):
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            fits = _measure(stem) > 1 and (suffix != "ion" or stem.endswith(("s", "t")))
            return stem if fits else word
    return word


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """Stem of a folded word; words of one or two letters stay."""
    if len(word) <= 2 or not word.isascii():
        return word
    word = _past_and_progressive(_plurals(word))
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _replace_longest(word, STEP_2, 0)
    word = _replace_longest(word, STEP_3, 0)
    word = _drop_ending(word)
    if word.endswith("e"):
        base = word[:-1]
        if _measure(base) > 1 or (_measure(base) == 1 and not _short_end(base)):
            word = base
    if _measure(word) > 1 and word.endswith("ll"):
        word = word[:-1]
    return word


@F.pandas_udf(ArrayType(StringType()))
def stem_tokens(tokens: pd.Series) -> pd.Series:
    return tokens.map(lambda words: [stem(w) for w in words], na_action="ignore")
