"""Near duplicates against all pairs."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from data_for_tests import ODD, WORDS, edited, prose

from sievelight.llm import neardup


def brute(rows, width, percent):
    sets = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        if d is not None:
            sets[d] = ({tuple(w[k : k + width]) for k in range(len(w) - width + 1)} or {tuple(w)}) if w else set()
    up = {d: d for d in sets}

    def top(d):
        while up[d] != d:
            d = up[d]
        return d

    for a, b in itertools.combinations(sets, 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            x, y = top(a), top(b)
            up[max(x, y)] = min(x, y)
    return {d: (len(s), top(d)) for d, s in sets.items()}


def group(seed, n, size=200, most=14):
    """Edited copies of one text: many of them are alike only through others."""
    r, base = random.Random(seed), prose(seed, size)
    return [edited(base, seed * 1000 + i, r.randint(0, most)) for i in range(n)]


def test_components_of_copies_and_near_copies(make):
    texts = [prose(i, 30 + i) for i in range(40)] + group(1, 60) + [prose(7, 37)] * 30 + [prose(7, 37).upper()] + [edited(prose(9, 39), 5, 1)] + ["a b c", "a b c", "a b d"]
    rows = [(i, t) for i, t in enumerate(random.Random(3).sample(texts, len(texts)))]
    for width, percent in ((4, 80), (5, 80), (3, 50)):
        got = neardup.near_duplicates(make(rows).repartition(4), width, percent).collect()
        want = brute(rows, width, percent)
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want and len(got) == len(rows)
        assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
        if width == 5:
            kept = neardup.distinct(make(rows), width, percent)
            assert kept.columns == make(rows).columns
            assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, c in want.values()})


def test_large_buckets_are_compared_in_blocks(make, monkeypatch):
    monkeypatch.setattr(neardup, "LISTED", 2)
    monkeypatch.setattr(neardup, "BLOCK", 8)
    rows = list(enumerate(group(2, 70, 150, 22)))
    got = neardup.near_duplicates(make(rows), 4, 80).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute(rows, 4, 80)


def test_odd_rows(make):
    got = neardup.near_duplicates(make([*ODD, (9, "one")]), 4, 80).collect()
    by = [(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got]
    assert len(by) == len(ODD) + 1
    assert {(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (9, 1, 4, False), (None, 2, None, True), (5, 1, 5, True)} <= set(by)
    assert by.count((4, 1, 4, True)) == 2
    assert neardup.near_duplicates(make([])).count() == 0
    once = neardup.distinct(make([*ODD, (9, "one")]))
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in once.collect()) == [(False, 0), *[(True, i) for i in range(1, 7)]]


@pytest.mark.parametrize("per_task", [3, 1000])
def test_components(spark, per_task):
    rng = np.random.default_rng(0)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 80, (45, 2))] + [(200 + i, 201 + i) for i in range(12)]
    got = {r["id"]: r["comp"] for r in neardup.components(spark.createDataFrame(pairs, "a bigint, b bigint"), per_task).collect()}
    up = {x: x for p in pairs for x in p}
    for _ in up:
        for a, b in pairs:
            up[a] = up[b] = min(up[a], up[b])
    assert got == {x: c for x, c in up.items() if any(x in p and p[0] != p[1] for p in pairs)}


def test_estimate_is_near_the_truth():
    rng = np.random.default_rng(1)
    for share in (0.3, 0.6, 0.8, 0.95):
        a, b = [], []
        for _ in range(60):
            both = rng.integers(0, 2**63, int(1000 * share), dtype="u8")
            rest = rng.integers(0, 2**63, (2, (1000 - len(both)) // 2), dtype="u8")
            for out, own in ((a, rest[0]), (b, rest[1])):
                out.append(neardup.sketch(np.unique(neardup._mix(np.concatenate([both, own])))))
        n = np.full(60, 1000 * share + 500 * (1 - share))
        assert neardup.estimate(np.array(a), np.array(b), n, n).mean() == pytest.approx(share, abs=0.015)


def test_shingles_of_words():
    assert len(neardup.shingles(b"a b c d e", 4)) == 2 and len(neardup.shingles(b"A\x0bb\tc  D", 4)) == 1
    assert (neardup.shingles(b"a b c d", 4) == neardup.shingles(b"A B\nC D", 4)).all()
    assert neardup.shingles(b"a b", 4)[0] != neardup.shingles(b"a b c", 4)[0] and len(neardup.shingles(None, 4)) == 0
    assert len(neardup.shingles(" ".join(WORDS).encode(), 5)) == len(WORDS) - 4
