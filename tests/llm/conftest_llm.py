"""Helpers that tests import by name."""

from __future__ import annotations

import random

WORDS = ("alpha bravo charlie delta echo foxtrot golf hotel india juliett kilo lima mike november oscar papa quebec "
         "romeo sierra tango uniform victor whiskey xray yankee zulu").split()


def prose(seed: int, n: int) -> str:
    """n words, each a pair of the list's, so that texts share few runs of words."""
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))
