"""Search for the smallest share of entries that keeps the accuracy, and sweeps over settings."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelight.operators import evaluate, score, search, topk


def exact_lists(triples: DataFrame, queries: DataFrame, k: int, cells: int | None = None) -> DataFrame:
    return topk.topk(score.multiply(triples, queries, cells=cells), k)


def quality(triples: DataFrame, queries: DataFrame, gold: DataFrame, rows: int, ck: int, depths: tuple[int, ...] = evaluate.DEPTHS, **options) -> DataFrame:
    """(k, avg_precision, recall) of the candidates against the exact lists ``gold``."""
    return evaluate.summary(evaluate.precision(gold, search.approximate(triples, queries, rows, ck, **options), depths))


def bisect(metric: Callable[[float], float], share: float, most: int = 100) -> tuple[float, list[tuple[float, float, bool]]]:
    """The least ratio that keeps ``share`` of the metric at ratio 1, to three decimals, and the steps taken.

    Starts at 0.5; the next ratio is the middle, rounded; a ratio that was tried ends the search.
    """
    floor = metric(1.0) * share
    low, high, ratio, steps, tried = 0.0, 1.0, 0.5, [], {1.0}
    while ratio not in tried and len(steps) < most:
        tried.add(ratio)
        got = metric(ratio)
        steps.append((ratio, got, got >= floor))
        low, high = (low, ratio) if got >= floor else (ratio, high)
        ratio = round((low + high) / 2, 3)
    return high, steps


def prune_ratio(triples: DataFrame, queries: DataFrame, rows: int, k: int, ck: int, share: float = 0.9999, cells: int | None = None, **options) -> DataFrame:
    """(step, ratio, metric, kept_accuracy) of the search, then its answer as the last row (step -1).

    The exact lists are computed once, for one set of queries, so that all steps are measured alike. What reaches the
    driver is one number a step.
    """
    spark = triples.sparkSession
    depths = tuple(d for d in evaluate.DEPTHS if d <= k)
    triples, gold = triples.persist(), exact_lists(triples, queries, k, cells).persist()
    try:
        metric = lambda ratio: evaluate.convergence(quality(triples, queries, gold, rows, ck, depths, ratio=ratio, cells=cells, **options)).first()["metric"]
        best, steps = bisect(metric, share)
    finally:
        triples.unpersist()
        gold.unpersist()
    out = [(i, r, m, ok) for i, (r, m, ok) in enumerate(steps)]
    return spark.createDataFrame([*out, (-1, best, next((m for r, m, _ in steps if r == best), None), True)], "step int, ratio double, metric double, kept_accuracy boolean")


def sweep(triples: DataFrame, queries: DataFrame, rows: int, k: int, grid: Iterable[dict], cells: int | None = None) -> DataFrame:
    """(settings..., k, avg_precision, recall) for every combination in ``grid``; each is a dict of ``ck``, ``split``,
    ``bits``, ``ratio``.

    The matrix, the queries and their exact lists are computed once for all settings. What reaches the driver is a row
    for each setting and depth.
    """
    depths = tuple(d for d in evaluate.DEPTHS if d <= k)
    held = [triples.persist(), queries.persist()]
    held.append(exact_lists(*held, k, cells).persist())
    try:
        out = None
        for g in grid:
            part = quality(held[0], held[1], held[2], rows, depths=depths, cells=cells, **g)
            for name, value in g.items():
                part = part.withColumn(name, F.lit(value))
            out = part if out is None else out.unionByName(part)
        return triples.sparkSession.createDataFrame(out.collect(), out.schema)
    finally:
        for x in held:
            x.unpersist()
