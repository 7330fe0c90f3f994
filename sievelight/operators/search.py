"""Two-stage search: few-bit scores choose candidates, exact scores rank them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelight.operators import layout, reduce, score, topk


def approximate(triples: DataFrame, queries: DataFrame, rows: int, ck: int, split: int = 1, bits: int = 6, ratio: float = 1.0, importance_mean: str = "nonzero", scheme: str = "dense", cells: int | None = None, positive_only: bool = False) -> DataFrame:
    """Candidates (qid, part, row_id, score) by integer scores of the pruned and quantised matrix."""
    if rows < split:
        raise ValueError(f"{rows} rows cannot be split into {split} parts")
    cols = layout.meta(triples).cols if importance_mean == "cells" else 0
    kept = reduce.prune(triples, ratio, importance_mean, rows * cols) if ratio < 1 else triples
    q = reduce.quantize(kept, bits, scheme)
    x = reduce.quantize_queries(queries, bits, scheme)
    scores = score.multiply(q, x, "q", "x", cells, integer=True) if "x" in x.columns else score.multiply(q, x.withColumnRenamed("q", "x"), "q", "x", cells, integer=True)
    if positive_only:
        scores = scores.filter("score > 0")
    return topk.candidates(scores, layout.split_of(F.col("row_id"), rows, split), split, ck)


def two_stage(triples: DataFrame, queries: DataFrame, rows: int, k: int, ck: int, **options) -> DataFrame:
    """(qid, rank, row_id, score): the exact top ``k`` of the candidates; ``options`` as in ``approximate``. A row's products
    are summed by column, so equal rows get equal scores."""
    found = approximate(triples, queries, rows, ck, **options).select("qid", "row_id")
    # ck rows a query: the matrix's entries of these rows only
    own = triples.join(found, "row_id")
    products = own.join(score._side(queries, options.get("cells")), ["qid", "col_id"]).select("qid", "row_id", F.struct("col_id", (F.col("val") * F.col("x")).alias("p")).alias("e"))
    exact = products.groupBy("qid", "row_id").agg(F.aggregate(F.array_sort(F.collect_list("e")), F.lit(0.0), lambda s, e: s + e["p"]).alias("score"))
    return topk.topk(exact, k)
