"""Quality and toxicity: held-out accuracy, odd rows, and what they may see."""

from __future__ import annotations

import random

import numpy as np
import pytest
from data_for_tests import ODD, prose
from pyspark.sql import functions as F

from sievelight.llm import quality, queries, toxicity

BAD = ["idiotic", "morons", "scumbag", "worthless"]


def labelled(n, spoil, seed):
    """Texts, of which every third is spoilt, and their labels."""
    texts, y = [], []
    for i in range(n):
        t = prose(seed + i, 20 + 5 * (i % 40)) + "."
        y.append(int(i % 3 == 0))
        texts.append(spoil(t, i) if y[-1] else t)
    return texts, np.array(y)


def toxic(t, i):
    r, w = random.Random(i), t.split()
    for _ in range(1 + len(w) // 40):
        w.insert(r.randrange(len(w) + 1), r.choice(BAD))
    return " ".join(w)


def junk(t, i):
    return t.upper().replace(" ", "!! ") if i % 2 else " ".join(w + "###" for w in t.split())


def test_toxicity_on_unseen_texts_and_misspellings():
    texts, y = labelled(600, toxic, 0)
    m = toxicity.train([t.encode() for t in texts], y, toxicity.Settings(steps=400))
    unseen, z = labelled(300, toxic, 5000)
    p = m.score([t.encode() for t in unseen])
    assert ((p >= 0.5) == z).mean() > 0.95
    # endings never seen share the vectors of the n-grams they keep
    plain = prose(77, 40)
    assert m.score([f"{plain} idiotically scumbagging moronsx".encode()])[0] > m.score([plain.encode()])[0] + 0.3
    # vectors and softmax give what the joint weights say
    again = toxicity.Model(m.settings, (m.table @ (m.softmax[:, 1] - m.softmax[:, 0])).astype("f4"), m.bias)
    assert np.allclose(again.score([unseen[0].encode()]), p[:1])


def test_toxicity_score_is_the_mean_read_by_the_softmax():
    """In plain Python: n-grams of the distinct words, hashed by the documented steps, the mean of their vectors, softmax."""
    texts, y = labelled(200, toxic, 0)
    s = toxicity.Settings(steps=60)
    m = toxicity.train([t.encode() for t in texts], y, s)
    assert 0 < (np.abs(m.table).sum(axis=1) > 0).sum() < 1 << s.bits

    def bucket(gram):
        h = 0
        for c in gram:
            h = (h * 0x01000193 + c) % 2**32
        return ((h ^ (h >> 15)) * 0x85EBCA6B) % 2**32 >> (32 - s.bits)

    for text in (b"You IDIOTIC scumbag, you scumbag!", b"a bc", "Ünïcode morons-1 morons".encode(), b"", prose(5, 30).encode()):
        words = "".join(chr(c) if c >= 128 or chr(c).isalnum() else " " for c in text).encode("latin1").lower().split()
        mean, n = np.zeros(s.dim), 0
        for w in dict.fromkeys(words):
            w = b" " + w + b" "
            for k in s.orders:
                for i in range(len(w) - k + 1):
                    mean, n = mean + m.table[bucket(w[i : i + k])], n + 1
        z = mean / (n + s.neutral) @ m.softmax
        assert m.score([text])[0] == pytest.approx(1 / (1 + np.exp(z[0] - z[1] - m.bias)), abs=1e-5)


def test_toxicity_on_a_small_table():
    """Held-out accuracy by the labels' split, where only some dozen texts are toxic."""
    from zlib import crc32

    import pandas as pd

    sf = "/root/testdata/sf0.01"
    docs = pd.read_parquet(f"{sf}/documents.parquet").merge(pd.read_parquet(f"{sf}/labels.parquet"), on="doc_id")
    texts, y = [t.encode() for t in docs["text"]], docs["toxic"].to_numpy()
    held = np.array([crc32(str(d).encode()) % 5 == 0 for d in docs["doc_id"]])
    m = toxicity.train([t for t, h in zip(texts, held, strict=True) if not h], y[~held], toxicity.Settings())
    p = m.score([t for t, h in zip(texts, held, strict=True) if h])
    bad, good = p[y[held] == 1], p[y[held] == 0]
    assert (bad[:, None] > good[None, :]).mean() >= 0.95
    assert (bad >= 0.5).mean() >= 0.3 and (good >= 0.5).mean() <= 0.05


def test_toxicity_odd_texts():
    m = toxicity.train([b"a bad thing", b"good things here"], np.array([1, 0]), toxicity.Settings(steps=20))
    p = m.score([None, b"", b" \n", b"x", b"word " * 40_000, "Ünïcode 中文".encode()])
    assert p[0] == p[1] == p[2] and np.isfinite(p).all() and ((p >= 0) & (p <= 1)).all()
    # texts are scored on their own, wherever chunks begin
    texts = [prose(i, 3000).encode() for i in range(90)]
    assert np.allclose(m.score(texts), [m.score([t])[0] for t in texts], atol=1e-6)
    assert toxicity.train([b"a"], np.array([0]), toxicity.Settings()).score([b"a"])[0] < 0.5
    assert toxicity.train([], np.array([], "i8"), toxicity.Settings()).score([b"a"])[0] < 0.5


def test_quality_without_a_negative_label():
    rng = np.random.default_rng(0)
    texts, bad = labelled(900, junk, 0)
    x = np.array([quality.features(t.encode()) for t in texts])
    good = np.flatnonzero(bad == 0)
    trusted = rng.permutation(good)[:250]
    unlabelled = np.setdiff1d(np.arange(len(texts)), trusted)
    s = quality.Settings(steps=500)
    prior = quality.class_prior(x[trusted], x[unlabelled], s)
    assert prior == pytest.approx((bad[unlabelled] == 0).mean(), abs=0.12)
    m = quality.train(x[trusted], x[unlabelled], s)
    unseen, z = labelled(300, junk, 7000)
    p = m.score(np.array([quality.features(t.encode()) for t in unseen]))
    assert ((p >= 0.7) == (z == 0)).mean() > 0.97


def test_quality_odd_texts():
    for t in (None, b"", b" ", b"\n\n", b"x", b"word " * 40_000, "Ünïcode 中文\x00".encode()):
        f = quality.features(t)
        assert f.shape == (quality.N_FEATURES,) and np.isfinite(f).all()
    none = np.zeros((0, quality.N_FEATURES))
    assert quality.train(none, none).score(np.zeros((1, quality.N_FEATURES)))[0] == 0.5


def test_queries_in_spark(spark, make):
    texts, bad = labelled(120, junk, 0)
    texts = [toxic(t, i) if i % 7 == 0 else t for i, t in enumerate(texts)]
    rows = [(100 + i, t) for i, t in enumerate(texts)] + ODD
    labels = spark.createDataFrame([(100 + i, int(1 - b), int(i % 7 == 0), "x") for i, b in enumerate(bad[:80])] + [(None, 1, 1, "x"), (5000, 1, 0, "x"), (101, None, None, "x")], "doc_id bigint, quality int, toxic int, text string")
    docs = make(rows).repartition(3)
    model = quality.fit(docs, labels, settings=quality.Settings(steps=200))
    tox = toxicity.fit(docs, labels, settings=toxicity.Settings(steps=60))
    for got in (queries._judged(quality.score(docs, model), 4, 2, 0.7), queries._judged(toxicity.score(docs, tox), 5, 0, 0.5)):
        out = got.collect()
        assert got.columns == ["doc_id", "held_out", "score", "predicted"]
        assert sorted(str(r["doc_id"]) for r in out) == sorted(str(d) for d, _ in rows)
        assert all(0 <= r["score"] <= 1 for r in out) and all(r["held_out"] is not None for r in out)
    kept = quality.good(docs, model)
    assert kept.columns == docs.columns and 0 < kept.count() < len(rows)
    assert toxicity.clean(docs, tox).filter(F.col("text_") == "t").count() <= len(rows)
    empty = make([])
    assert quality.score(empty, quality.fit(empty, labels.limit(0))).count() == 0
    assert toxicity.score(empty, toxicity.fit(empty, labels.limit(0))).count() == 0


def test_all_documents_labelled(spark, make):
    texts, bad = labelled(150, junk, 0)
    labels = spark.createDataFrame([(i, int(1 - b)) for i, b in enumerate(bad)], "doc_id bigint, quality int")
    docs = make(list(enumerate(texts)))
    kept = {r["doc_id"] for r in quality.good(docs, quality.fit(docs, labels, settings=quality.Settings(steps=300))).collect()}
    assert sum((i in kept) == (b == 0) for i, b in enumerate(bad)) >= 140


def test_held_out_labels_are_not_learnt_from(spark, make):
    texts, _ = labelled(30, toxic, 0)
    docs = make(list(enumerate(texts)))
    labels = spark.createDataFrame([(i, 1) for i in range(30)], "doc_id bigint, toxic int")
    rows = toxicity.sample(docs, labels, "toxic", 1000, queries.common.split_of("doc_id", 5) != 0).select("doc_id").collect()
    from zlib import crc32

    assert sorted(r["doc_id"] for r in rows) == [i for i in range(30) if crc32(str(i).encode()) % 5]


def test_prior_is_read_from_every_unlabelled_document(spark, make, monkeypatch):
    texts, bad = labelled(240, junk, 0)
    docs = make(list(enumerate(texts)))
    labels = spark.createDataFrame([(i, 1) for i in range(240) if i % 3 == 1], "doc_id bigint, quality int")
    read, real = [], quality.class_prior

    def watched(p, u, s, pool=None):
        return real(p, u, s, pool and (lambda m, cuts: read.append(pool(m, cuts)) or read[-1]))

    monkeypatch.setattr(quality, "class_prior", watched)
    model = quality.fit(docs, labels, settings=quality.Settings(unlabelled=40, steps=100))
    assert [r.sum() for r in read] == [160 - 20] and 0 < model.prior < 1


def test_prior_is_read_in_one_way_at_any_size(spark, make, monkeypatch):
    """Whether the sample has all unlabelled documents or all but one, the same estimator reads every one of them."""
    texts, bad = labelled(120, junk, 0)
    docs = make(list(enumerate(texts)))
    labels = spark.createDataFrame([(i, 1) for i in range(120) if i % 3 == 1], "doc_id bigint, quality int")
    read, real = [], quality.class_prior

    def watched(p, u, s, pool=None):
        return real(p, u, s, pool and (lambda m, cuts: read.append((len(m), pool(m, cuts).sum())) or pool(m, cuts)))

    monkeypatch.setattr(quality, "class_prior", watched)
    priors = [quality.fit(docs, labels, settings=quality.Settings(unlabelled=n, steps=100, repeats=2)).prior for n in (80, 78)]
    assert read == [(4, 80 - 40), (4, 80 - 39)] and abs(priors[0] - priors[1]) < 0.1


def test_first_classifiers_never_read_what_they_saw():
    x = np.random.default_rng(0).normal(size=(40, 3))
    p, u = x[:20], np.concatenate([x[10:], x[15:35]])  # rows of both kinds, and rows that repeat
    for ids in (None, (np.arange(20), np.concatenate([np.arange(10, 40), np.arange(15, 35)]))):
        splits = list(quality._halves(p, u, quality.Settings(repeats=3), ids))
        for hp, hu in splits:
            assert not {r.tobytes() for r in np.concatenate([p[hp], u[hu]])} & {r.tobytes() for r in np.concatenate([p[~hp], u[~hu]])}
            assert len({r.tobytes() for r in u[hu]}) == 15
        assert len(splits) == 6 and all((a[1] ^ b[1]).all() for a, b in zip(splits[::2], splits[1::2], strict=True))


def test_quality_risk_and_gradient_against_plain_python():
    """The risk summed in loops, and its gradient by differences, where the negatives' part is positive."""
    from math import exp, log

    rng = np.random.default_rng(3)
    gp, gu = rng.normal(1, 1, 7), rng.normal(-0.5, 1, 11)
    loss = lambda g, y: log(1 + exp(-g if y else g))

    def plain(gp, gu, prior):
        as_one = sum(loss(g, 1) for g in gp) / len(gp)
        negative = sum(loss(g, 0) for g in gu) / len(gu) - prior * sum(loss(g, 0) for g in gp) / len(gp)
        return prior * as_one + max(0.0, negative), negative

    for prior in (0.1, 0.3, 0.9):
        got, dp, du = quality.risk(gp, gu, prior)
        want, negative = plain(gp, gu, prior)
        assert got == pytest.approx(want)
        for side, push in ((0, dp), (1, du)):
            for i in range(len(push)):
                near = [gp.copy(), gu.copy()]
                near[side][i] += 1e-6
                slope = (plain(*near, prior)[0] - want) / 1e-6
                raised = (plain(*near, prior)[1] - negative) / 1e-6
                assert push[i] == pytest.approx(slope if negative >= 0 else -raised, abs=1e-5)
    assert plain(gp, gu, 0.1)[1] > 0 > plain(gp, gu, 0.9)[1]  # both sides of the bound were met

    xp, xu = rng.normal(size=(7, 5)), rng.normal(size=(11, 5))
    layers = [rng.normal(size=(5, 3)), rng.normal(size=3), rng.normal(size=3), np.zeros(())]
    value = lambda at: quality.risk(*(np.tanh(x @ at[0] + at[1]) @ at[2] + at[3] for x in (xp, xu)), 0.2)[0]
    for k, g in enumerate(quality.gradients(layers, xp, xu, 0.2)):
        for i in np.ndindex(g.shape):
            near = [x.copy() for x in layers]
            near[k][i] += 1e-6
            assert g[i] == pytest.approx((value(near) - value(layers)) / 1e-6, abs=1e-4)


def test_quality_on_a_small_table():
    """Held-out accuracy by the labels' split, where a few hundred documents are all there is."""
    from zlib import crc32

    import pandas as pd

    sf = "/root/testdata/sf0.01"
    docs = pd.read_parquet(f"{sf}/documents.parquet").merge(pd.read_parquet(f"{sf}/labels.parquet"), on="doc_id", how="left")
    x = np.array([quality.features(t.encode()) for t in docs["text"]], "f8")
    held = np.array([crc32(str(d).encode()) % 4 == 2 for d in docs["doc_id"]])
    p, u = np.flatnonzero((docs["quality"] == 1) & ~held), np.flatnonzero(~held)
    score = quality.train(x[p], x[u], ids=(p, u)).score(x)
    good, bad = score[held & (docs["quality"] == 1)], score[held & (docs["quality"] == 0)]
    assert (good[:, None] > bad[None, :]).mean() >= 0.95
    assert (bad >= 0.7).mean() < 0.1 and (good >= 0.7).mean() > 0.9
