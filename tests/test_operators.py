"""Cases worked out by hand, and properties."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievelight.functions import expected_precision, published_estimate, to_half
from sievelight.operators import evaluate, graph, layout, reduce, score, search, topk, tune
from sievelight.sources import generators

A = [(0, 0, 1.0), (0, 2, -0.5), (1, 1, 0.25), (1, 3, 0.75), (2, 0, -1.0), (3, 1, 0.5), (3, 2, 0.5)]
X = [1.0, 2.0, 0.0, -1.0]


@pytest.fixture(scope="module")
def a(spark):
    return spark.createDataFrame(A, "row_id bigint, col_id int, val double")


@pytest.fixture(scope="module")
def x(spark):
    return spark.createDataFrame([(0, c, v) for c, v in enumerate(X)], "qid bigint, col_id int, x double")


def values(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.orderBy(*[c for c in ("qid", "rank", "row_id", "col_id") if c in df.columns]).collect()]


def test_product_and_lists(a, x):
    s = score.multiply(a, x, cells=4)
    assert values(s, "score") == [(1.0,), (-0.25,), (-1.0,), (1.0,)]
    assert values(topk.topk(s, 2), "row_id") == [(3,), (0,)]
    assert values(topk.topk(s, 4, least=0.0), "row_id") == [(3,), (0,)]
    best = topk.candidates(s, layout.split_of(F.col("row_id"), 4, 2), 2, 2)
    assert {(r["part"], r["row_id"]) for r in best.collect()} == {(0, 0), (1, 3)}


def test_quantisers(a, x):
    q = reduce.quantize(a)
    assert values(q, "q") == [(v,) for v in (31, -16, 8, 23, -31, 16, 16)]
    assert values(reduce.quantize(a, scheme="csr"), "q") == [(v,) for v in (31, -16, 8, 24, -32, 16, 16)]
    xq = reduce.quantize_queries(x)
    assert values(xq, "q") == [(v,) for v in (16, 31, 0, -16)]
    s = score.multiply(q, xq.withColumnRenamed("q", "x"), "q", "x", integer=True)
    assert values(s, "score") == [(496,), (-120,), (-496,), (496,)]


def test_pruning(a):
    assert values(reduce.prune(a, 0.5), "row_id", "col_id") == [(0, 0), (1, 3), (2, 0), (3, 1)]
    assert values(reduce.prune(a, 0.5, "cells", 16), "row_id", "col_id") == [(0, 0), (0, 2), (1, 3), (2, 0), (3, 1), (3, 2)]
    assert values(reduce.prune(a, 1.0), "val") == values(a, "val")
    assert reduce.prune(a, 1e-9).groupBy("row_id").count().filter("count <> 1").count() == 0


def test_packets_by_hand_and_round_trip(spark, a):
    q = reduce.quantize(a)
    one = layout.row_bit_packets(q, F.lit(0)).collect()
    assert len(one) == 1 and one[0]["row_bits"] == 52 and one[0]["used"] == 7 and len(one[0]["cols"]) == 30
    back = layout.decode_row_bits(layout.row_bit_packets(q, F.lit(0), lanes=3)).orderBy("row_no", "col_id").collect()
    assert [(r["row_no"], r["col_id"], r["q"]) for r in back] == [(r["row_id"], r["col_id"], r["q"]) for r in q.orderBy("row_id", "col_id").collect()]


@pytest.mark.parametrize("lanes", [2, 3, 11])
def test_row_end_packets_round_trip(a, lanes):
    q = reduce.quantize(a)
    back = layout.decode_row_ends(layout.row_end_packets(q, F.lit(0), lanes)).orderBy("row_no", "col_id").collect()
    assert [(r["row_no"], r["col_id"], r["q"]) for r in back] == [(r["row_id"], r["col_id"], r["q"]) for r in q.orderBy("row_id", "col_id").collect()]


def test_half_precision(spark):
    x = [0.1, -1.0, 1e-9, 65504.0, 3.14159]
    got = spark.createDataFrame([(v,) for v in x], "v double").select(to_half(F.col("v")).alias("h")).collect()
    assert [r["h"] for r in got] == [float(np.float16(v)) for v in x]


def test_trials_are_near_the_expected_precision(spark):
    got = topk.merged_precision(generators.trials(spark, 40, 2000, seed=1), 2000, 8, 8, (40,)).agg(F.avg("precision")).first()[0]
    assert got == pytest.approx(expected_precision(2000, 8, 40, 8), abs=0.02)


def test_stats_and_shapes(spark, a):
    m = layout.meta(a, 4, 4)
    assert (m.rows, m.cols, m.nnz, m.density) == (4, 4, 7, 0.4375)
    assert layout.meta(a.limit(0)).rows == 0
    dense = layout.to_dense(a, 4)
    assert sorted(map(tuple, layout.to_triples(dense, keep_zeros=False).collect())) == sorted(A)
    twice = a.unionByName(a)
    assert layout.deduplicated(twice).filter("row_id = 0 and col_id = 0").first()["val"] == 2.0
    with pytest.raises(Exception, match="twice"):
        layout.deduplicated(twice, "error").collect()


def test_splits():
    with pytest.raises(ValueError):
        layout.split_of(F.lit(0), 3, 4)
    with pytest.raises(ValueError):
        topk.candidates(None, None, 8, 4)


@pytest.mark.parametrize("n,parts", [(10, 3), (64, 32), (100, 7), (33, 32)])
def test_balanced_split_sizes(spark, n, parts):
    got = spark.range(n).select(layout.split_of(F.col("id"), n, parts, "balanced").alias("p")).groupBy("p").count().orderBy("p").collect()
    assert [r["count"] for r in got] == [n // parts + (i < n % parts) for i in range(parts)]


def test_search_is_exact_with_all_candidates(spark):
    m = generators.sparse(spark, 300, 32, 8, seed=4)
    q = generators.queries(spark, 3, 32, seed=5)
    exact = topk.topk(score.multiply(m, q), 10)
    both = search.two_stage(m, q, 300, 10, 300, bits=8)
    assert values(exact, "qid", "row_id") == values(both, "qid", "row_id")
    some = [evaluate.summary(evaluate.precision(exact, search.approximate(m, q, 300, ck, bits=4), (10,))).first()["avg_precision"] for ck in (10, 40, 160)]
    assert some == sorted(some)


def test_dense_lists_equal_numpy(spark):
    rng = np.random.default_rng(0)
    m, q = rng.normal(size=(200, 8)), rng.normal(size=(3, 8))
    table = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(m)], "row_id bigint, embedding array<double>").repartition(3)
    got = topk.topk(score.dense_topk(table, q, 5), 5)
    want = [(n, i) for n in range(3) for i in np.argsort(-(m @ q[n]), kind="stable")[:5].tolist()]
    assert values(got, "qid", "row_id") == want


def test_ranking_metrics(spark):
    lists = lambda ids: spark.createDataFrame([(0, k + 1, i, 4.0 - k) for k, i in enumerate(ids)], "qid bigint, rank int, row_id bigint, score double")
    gold, test = lists([3, 0, 1, 2]), lists([0, 3, 1, 5])
    assert evaluate.positions_differ(gold, test, 4).first()["errors"] == 3
    assert evaluate.swap_errors(gold, test).first()["errors"] == 2
    assert evaluate.edit_distance(gold, test, 4).first()["distance"] == 3
    assert evaluate.precision(gold, test.limit(1), (1,)).first()["precision"] == 0
    assert evaluate.precision(gold, test, (1,)).first()["precision"] == 1
    assert evaluate.ndcg_by_value(gold, gold).first()["ndcg"] == 1 and evaluate.ndcg_by_rank(gold, gold, 3).first()["ndcg"] == 1
    assert [r["place"] for r in evaluate.gold_places(gold, test).orderBy("rank").collect()] == [2, 1, 3, 1000]
    ones = spark.createDataFrame([(k, 1.0, 1.0) for k in evaluate.DEPTHS], "k int, avg_precision double, recall double")
    assert round(evaluate.convergence(ones).first()["metric"], 7) == 1.2620833


def test_edit_distance_by_the_cost_of_a_missing_id(spark):
    rng = np.random.default_rng(1)
    lists = [[rng.permutation(24)[:20].tolist() for _ in range(2)] for _ in range(6)]
    lists += [[list(range(20)), [99, *range(19)]], [list(range(20)), [*range(1, 20), 0]], [list(range(5)), list(range(2, 9))]]
    table = lambda w: spark.createDataFrame([(q, k + 1, i) for q, both in enumerate(lists) for k, i in enumerate(both[w])], "qid bigint, rank int, row_id bigint")

    def plain(a, b, cost):
        last = [cost * k for k in range(len(b) + 1)]
        for i, x in enumerate(a):
            row = [cost * (i + 1)]
            for k, y in enumerate(b):
                row.append(min(last[k + 1] + cost, row[k] + cost, last[k] + (x != y)))
            last = row
        return last[-1]

    for cost in (1, 2):
        got = {r["qid"]: r["distance"] for r in evaluate.edit_distance(table(0), table(1), 20, cost).collect()}
        assert got == {q: plain(*both, cost) for q, both in enumerate(lists)}
    with pytest.raises(ValueError):
        evaluate.edit_distance(table(0), table(1), 20, 3)


def test_pagerank_mass(spark):
    e = generators.graph(spark, 40, 3, seed=6)
    r = graph.pagerank(graph.out_degree_weights(e.filter("src > 5")), spark.range(40).withColumnRenamed("id", "node"), iterations=4)
    assert abs(r.agg(F.sum("rank")).first()[0] - 1) < 1e-12


def test_bisection():
    best, steps = tune.bisect(lambda r: 1.0 if r >= 0.7312 else 0.5, 0.99)
    assert best == pytest.approx(0.732, abs=0.0011) and steps[0][0] == 0.5


def test_bounds_against_trials():
    rng = np.random.default_rng(1)
    hits = []
    for _ in range(400):
        parts = rng.permutation(1000)[:40] // 125
        hits.append(sum(min(8, c) for c in np.bincount(parts, minlength=8)) / 40)
    assert expected_precision(1000, 8, 40, 8) == pytest.approx(np.mean(hits), abs=0.01)
    assert published_estimate(1000, 8, 8, 8) == 1 and published_estimate(1000, 2, 40, 8) < 0.5


def test_empty_rows_and_fill(spark, a):
    q = reduce.quantize(a).filter("row_id <> 2")
    filled = reduce.fill_empty_rows(q, spark.range(4).withColumnRenamed("id", "row_id"), F.col("row_id") % 4)
    assert [tuple(r) for r in filled.filter("row_id = 2").collect()] == [(2, 2, 1)]
    assert layout.with_diagonal(a.filter("row_id < 2"), 4).filter("val = 0").count() == 2
