"""Expected precision of a top-k that is merged from parts that each keep a few rows."""

from __future__ import annotations

from fractions import Fraction
from itertools import accumulate
from math import comb


def published_estimate(n: int, parts: int, k: int, kept: int) -> float:
    """The published estimate of the mean precision over the first k places; it overstates.

    Place j is taken as 1 - parts * sum of C(n / parts, i) for i from kept + 1 to j - 1, over C(n, j): it counts the ways
    in which one part holds i of the best rows, but not how the others are dealt, so it is above the exact value of
    ``expected_precision``. Places up to ``kept`` count 1, places that the parts cannot fill together count 0.
    """
    reached = min(k, parts * kept)
    crowded = accumulate((comb(n // parts, i) for i in range(kept + 1, reached)), initial=0)
    missed = sum(Fraction(parts * ways, comb(n, j)) for j, ways in enumerate(crowded, kept + 1) if j <= reached)
    return float((reached - missed) / k)


def expected_precision(n: int, parts: int, k: int, kept: int) -> float:
    """Exact expected share of the top k that survives when rows are dealt at random and every part keeps ``kept``.

    One part's share of the top k is hypergeometric; what exceeds ``kept`` is lost.
    """
    own = n // parts
    total = comb(n, k)
    mean = sum(Fraction(comb(own, i) * comb(n - own, k - i), total) * min(i, kept) for i in range(min(own, k) + 1))
    return float(min(Fraction(1), parts * mean / k))
