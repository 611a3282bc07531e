"""Rows of small test documents."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _digest string, salt int, slot long, length int, fp long, _row int, kept boolean"

WORDS = "the of and river stone light morning paper under bridge window silver quiet garden letter winter market road table summer".split()


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", "s", "ed", "ing"]) for _ in range(n))


def rows_of(texts):
    """Documents with ids from 0, with columns whose names clash with the operators' own."""
    return [(i, t, "en", "s", None, "d", 1, 2, 3, 4, 5, True) for i, t in enumerate(texts)]
