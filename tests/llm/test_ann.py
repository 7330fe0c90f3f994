"""Nearest neighbours against brute force."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievelight.llm import ann


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, rank int, rep int, v string")


def filled(rows):
    return [(i, None if x is None else [None if c is None else float(c) for c in x], 1, 2, "x") for i, x in rows]


def brute(rows, k, query):
    good = [(i, np.array(x, "f8")) for i, x in rows if i is not None and x is not None and None not in list(x) and np.isfinite(x).all() and np.any(x)]
    out = {}
    for i, x in good:
        if query(i):
            s = sorted((-float((x * y).sum()), j) for j, y in good if j != i)[:k]
            out[i] = [(j, -c) for c, j in s]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        own = out.setdefault(r["query_id"], [])
        assert r["rank"] == len(own) + 1
        own.append((r["vec_id"], r["score"]))
    return out


def test_all_found_in_a_small_table(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=6) * rng.uniform(0.2, 3)) for i in range(150)]
    got = found(ann.nearest(table(spark, filled(rows)).repartition(4), F.col("vec_id") % 10 == 0, k=5))
    want = brute(rows, 5, lambda i: i % 10 == 0)
    assert {q: [j for j, _ in x] for q, x in got.items()} == {q: [j for j, _ in x] for q, x in want.items()}
    assert all(abs(a[1] - b[1]) < 1e-12 for q in want for a, b in zip(got[q], want[q], strict=True))


def test_narrow_windows_keep_the_recall(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 16))
    rows = [(i, centres[i % 40] + 0.4 * rng.normal(size=16)) for i in range(4000)]
    s = ann.Settings(curves=12, least=32, most=64, sample=60)
    got = found(ann.nearest(table(spark, filled(rows)), F.col("vec_id") % 20 == 0, k=10, settings=s))
    x = np.array([v for _, v in rows])
    hits = n = 0
    for q, own in got.items():
        score = x @ x[q]
        score[q] = -np.inf
        hits += len(set(np.argsort(-score)[:10].tolist()) & {j for j, _ in own})
        n += 10
    assert n == 2000 and hits / n >= 0.9


def test_hot_vectors_and_odd_rows(spark):
    same, other = [1.0, 2.0, 0.5], [0.5, -1.0, 0.0]
    rows = [(i, same) for i in range(60)] + [(100 + i, [1.0, 2.0, 0.5 + i / 9]) for i in range(9)] + [(120, other), (140, [-0.0, 3.0, 0.0]), (141, [0.0, 3.0, 0.0])]
    odd = [(160, None), (180, [0.0, 0.0, 0.0]), (200, [1.0, None, 2.0]), (220, [1.0, float("nan"), 2.0]), (240, [1.0, float("inf"), 2.0]), (260, [9.0]), (None, same), (280, [])]
    got = found(ann.nearest(table(spark, filled(rows + odd)), F.col("vec_id") % 20 == 0, k=4))
    assert got == brute(rows, 4, lambda i: i % 20 == 0)


def test_few_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (20, [0.0, 2.0])]
    assert found(ann.nearest(table(spark, filled(rows)), F.col("vec_id") % 20 == 0)) == brute(rows, 20, lambda i: i % 20 == 0)
    assert ann.nearest(table(spark, filled(rows[1:2])), F.col("vec_id") % 20 == 0).count() == 0
    assert ann.nearest(table(spark, []), F.col("vec_id") % 20 == 0).count() == 0
    assert found(ann.nearest(table(spark, filled(rows[:1])), F.col("vec_id") % 20 == 0)) == {}


def test_ties_go_to_the_smaller_id(spark):
    rng = np.random.default_rng(5)
    near = np.column_stack([np.full(1000, 2.0), rng.normal(size=(1000, 3))])
    at = np.argpartition(-near[:, 1], 5)[:5]
    ids = rng.permutation(np.arange(1, 20_000, 20))[:1000]
    best = ann._best(np.array([[1.0, 0, 0, 0], [1.0, 1.0, 0, 0]]), near, ids, np.arange(1000), np.array([-1, -1]), 5)
    assert best[0][1].tolist() == sorted(ids.tolist())[:5] and set(best[1][1].tolist()) == set(ids[at].tolist())
    rows = [(0, [1.0, 0, 0, 0]), *zip(ids.tolist(), near.tolist(), strict=True)]
    got = found(ann.nearest(table(spark, filled(rows)).repartition(5), F.col("vec_id") == 0, k=20, settings=ann.Settings(least=2000)))
    assert got == {0: [(i, 2.0) for i in sorted(ids.tolist())[:20]]}


def test_repeated_ids_are_rows_of_their_own(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0]), (2, [3.0, 0.5])]
    got = ann.nearest(table(spark, filled(rows)), F.col("vec_id") == 0, k=3).collect()
    lists = sorted([(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got])
    # of the first query: 2 (3.0), 1, 1 (1.0); of the second: 1, 1 (1.0), 2 (0.5); the other row 0 scores 0
    assert lists == sorted([(0, 1, 2, 3.0), (0, 2, 1, 1.0), (0, 3, 1, 1.0), (0, 1, 1, 1.0), (0, 2, 1, 1.0), (0, 3, 2, 0.5)])


def test_floats_keep_their_exact_products(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(80, 5)).astype("f4")
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    got = found(ann.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"), F.col("vec_id") % 20 == 0, k=7))
    want = brute(rows, 7, lambda i: i % 20 == 0)
    assert {q: [j for j, _ in v] for q, v in got.items()} == {q: [j for j, _ in v] for q, v in want.items()}
    assert all(abs(a[1] - b[1]) < 1e-14 for q in want for a, b in zip(got[q], want[q], strict=True))


@pytest.mark.parametrize("dims,bits", [(2, 3), (3, 2), (4, 2)])
def test_curve_visits_every_cell_by_single_steps(dims, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), axis=-1).reshape(-1, dims)
    key = ann.hilbert(cells, bits)
    assert sorted(key.tolist()) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(axis=1) == 1).all()
