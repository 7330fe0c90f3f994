"""The language model against sums over all paths, and its base against plain counting."""

from __future__ import annotations

import itertools
import math
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from data_for_tests import ODD, prose
from pyspark.sql import functions as F

from sievelight.llm import common, hmm


def some(states, classes, seed):
    rng = np.random.default_rng(seed)
    norm = lambda x, axis: x / x.sum(axis=axis, keepdims=True)
    return hmm.Model(norm(rng.random(states), 0), norm(rng.random((states, states)), 1), norm(rng.random((classes, states)), 0))


def paths(m, seq):
    total, post = 0.0, np.zeros((len(seq), len(m.first)))
    for p in itertools.product(range(len(m.first)), repeat=len(seq)):
        w = m.first[p[0]] * math.prod(m.move[a, b] for a, b in itertools.pairwise(p)) * math.prod(m.emit[c, s] for c, s in zip(seq, p, strict=True))
        total += w
        for t, s in enumerate(p):
            post[t, s] += w
    return total, post / total


def test_forward_and_expected_counts_equal_all_paths():
    m = some(3, 5, 0)
    seqs = [np.array(x, "i4") for x in ([0, 4, 2, 2, 1, 3], [1, 1, 0], [2, 0], [4])]  # longest first
    want = [paths(m, s.tolist()) for s in seqs]
    assert hmm.forward(m, seqs) == pytest.approx([math.log10(w) for w, _ in want])
    first, move, emit = np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3))
    assert hmm.expected(m, seqs, first, move, emit) == pytest.approx(sum(math.log10(w) for w, _ in want))
    assert first == pytest.approx(sum(p[0] for _, p in want))
    by_class = np.zeros((5, 3))
    for s, (_, p) in zip(seqs, want, strict=True):
        np.add.at(by_class, s, p)
    assert emit == pytest.approx(by_class)
    assert move.sum(axis=1) == pytest.approx(sum(p[:-1].sum(axis=0) for _, p in want))


def test_em_never_gets_worse():
    rng, s = np.random.default_rng(1), hmm.Settings(states=3, own=4, endings=3, prior=1e-9)
    seqs = [np.append(rng.integers(0, 7, n), 7).astype("i4") for n in sorted(rng.integers(3, 30, 40))[::-1]]
    m, share, likes = some(3, 8, 2), np.full(8, 1 / 8), []
    for _ in range(8):
        sums = np.zeros(3), np.zeros((3, 3)), np.zeros((8, 3))
        likes.append(hmm.expected(m, seqs, *sums))
        m = hmm.Model(sums[0] / sums[0].sum(), sums[1] / sums[1].sum(axis=1, keepdims=True), sums[2] / sums[2].sum(axis=0))
    assert all(b >= a - 1e-9 for a, b in itertools.pairwise(likes))
    assert share.sum() == 1 and s.classes == 8


def test_scores(spark, make):
    rows = [*ODD, *[(100 + i, prose(i % 30, 20 + i)) for i in range(80)]]
    docs = make(rows).repartition(3)
    s = hmm.Settings(states=2, own=5, endings=7, start_docs=20, passes=1)
    got = hmm.language_model(docs, common.split_of("doc_id", 10) != 0, s, head=8).collect()
    tokens = {(d, t): [*(t or "").encode().lower().split(), None] for d, t in rows}
    c = Counter(w for d, t in rows if d is not None and crc32(str(d).encode()) % 10 for w in tokens[d, t])
    n, v = sum(c.values()), len(c)
    want = sorted((str(d), len(w), sum(x in c for x in w), round(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 4)) for d, t in rows for w in [tokens[d, t]])
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 4)) for r in got) == want
    assert all(r["train_tokens"] == n and r["score"] < 0 and math.isfinite(r["score"]) for r in got)


def test_probabilities_of_all_words_sum_to_one(spark, make):
    """One state, one token: the chances of every type, known or not, and the end add up to one."""
    rows = [(i, prose(i, 10)) for i in range(1, 30)]
    s = hmm.Settings(states=1, own=3, endings=2, start_docs=5, passes=1, prior=0.0)
    docs = make(rows, extra=False)
    words = hmm.count_words(docs)
    lex = hmm.lexicon(words, len(rows), s, head=4)
    model = hmm.train(docs, lex)
    assert model.emit.sum(axis=0) == pytest.approx(1)
    counts = {r["word"]: r["c"] for r in words.collect()}
    lex.prepare()
    inside = Counter()
    for w, c in counts.items():
        k = int(lex.classes([w])[1][0])
        inside[k] += (c + hmm.ADDED) / lex.mass[k]
    for k in inside:
        assert inside[k] + (hmm.ADDED / lex.mass[k] if k >= s.own else 0) == pytest.approx(1)
    assert lex.mass.sum() == pytest.approx(sum(counts.values()) + len(rows) + hmm.ADDED * (len(counts) + 1 + s.endings))


def test_class_of_a_word_is_the_same_in_sql(spark):
    s = hmm.Settings()
    words = [b"a", b"ab", b"abc", b"abcdef", "é".encode(), b"\xff\x00zz", b""]
    got = spark.createDataFrame([(bytearray(w),) for w in words], "w binary").select("w", hmm.ending_sql(F.col("w"), s).alias("k")).collect()
    assert all(r["k"] == hmm.ending(bytes(r["w"]), s) for r in got)


def test_nothing_to_learn_from(spark, make):
    got = hmm.language_model(make(ODD), F.lit(False)).collect()
    assert len(got) == len(ODD) and all(r["base_score"] == 0 and r["train_tokens"] == 0 and r["n_known"] == 0 for r in got)
    assert {r["doc_id"]: r["n_tokens"] for r in got}[5] == 40_001
    assert hmm.language_model(make([]), F.lit(True)).count() == 0
