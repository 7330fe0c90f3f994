"""Texts for the tests."""

from __future__ import annotations

import random

WORDS = [f"{a}{b}{c}" for a in ("th", "er", "on", "an", "re") for b in ("a", "e", "i", "o") for c in ("nt", "st", "ly", "ng", "d", "r")]


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def edited(text: str, seed: int, n: int) -> str:
    r, w = random.Random(seed), text.split()
    for i in r.sample(range(len(w)), n):
        w[i] = f"x{seed}y{i}"
    return " ".join(w)


#: Rows that every operator must take: nulls, empty and blank texts, repeats, a long text, columns with names of ours.
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (None, "no id here at all"), (5, "word " * 40_000), (6, "Ünïcode 中文 words\x00 and <|endoftext|>  two  blanks ")]
