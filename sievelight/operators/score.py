"""Matrix times vectors, as a join on the column and a sum by row; dense rows need no shuffle at all."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Query cells that may be broadcast (16 bytes each); more are joined by a shuffle.
BROADCAST_CELLS = 1_000_000


def _side(queries: DataFrame, cells: int | None) -> DataFrame:
    return F.broadcast(queries) if cells is not None and cells <= BROADCAST_CELLS else queries


def multiply(triples: DataFrame, queries: DataFrame, val: str = "val", x: str = "x", cells: int | None = None, integer: bool = False) -> DataFrame:
    """(qid, row_id, score) of triples and queries (qid, col_id, x): rows that share no column with a query are absent.

    ``cells``: how many rows ``queries`` has, if that is known; up to BROADCAST_CELLS they are broadcast. ``integer``
    sums in 64 bits.
    """
    product = F.col(val).cast("bigint") * F.col(x).cast("bigint") if integer else F.col(val) * F.col(x)
    return triples.join(_side(queries, cells), "col_id").groupBy("qid", "row_id").agg(F.sum(product).alias("score"))


def with_empty_rows(scores: DataFrame, rows: DataFrame, qids: DataFrame) -> DataFrame:
    """Every row of ``rows`` for every query: absent scores are 0."""
    zero = F.lit(0).cast(scores.schema["score"].dataType)
    pairs = rows.select("row_id").distinct().crossJoin(F.broadcast(qids.select("qid").distinct()))  # the result has these rows
    return pairs.join(scores, ["qid", "row_id"], "left").select("qid", "row_id", F.coalesce("score", zero).alias("score"))


def transposed(triples: DataFrame) -> DataFrame:
    return triples.select(F.col("col_id").cast("bigint").alias("row_id"), F.col("row_id").cast("int").alias("col_id"), "val")


def dense_dot(vector: Column, query: Column) -> Column:
    """Inner product of two arrays, summed from the left in doubles."""
    return F.aggregate(F.zip_with(vector, query, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, p: s + p)


def dense_scores(dense: DataFrame, queries: DataFrame, cells: int | None = None) -> DataFrame:
    """(qid, row_id, score) of dense rows (row_id, embedding) and dense queries (qid, x), as ``multiply`` has it of their
    triples. Each product is summed from the left before any shuffle: equal vectors get equal scores, also where an
    aggregation that runs out of memory would add a row's products in another order. ``cells`` as in ``multiply``."""
    both = dense.select("row_id", "embedding").crossJoin(_side(queries.select("qid", "x"), cells))
    products = F.zip_with("embedding", "x", lambda a, b: a.cast("double") * b.cast("double"))
    total = F.aggregate(products, F.lit(None).cast("double"), lambda s, p: F.coalesce(s + p, s, p))  # null: nothing shared
    return both.select("qid", "row_id", total.alias("score")).groupBy("qid", "row_id").agg(F.sum("score").alias("score")).filter("score is not null")


def dense_topk(dense: DataFrame, queries: np.ndarray, k: int, row: str = "row_id", vector: str = "embedding") -> DataFrame:
    """(qid, row_id, score): each task's ``k`` best rows for every query, by one matrix product a batch.

    Feed this to ``topk.topk``: only k rows a query and task are shuffled. Scores are inner products in doubles; ties go
    to the larger row_id. ``queries``: (number, components).
    """
    width, held = queries.shape[1], dense.sparkSession.sparkContext.broadcast(np.ascontiguousarray(queries, dtype="f8"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = held.value
        best_s, best_i = np.full((len(q), 0), -np.inf), np.zeros((len(q), 0), "i8")
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype("f8").reshape(b.num_rows, width)
            s = np.concatenate([best_s, q @ x.T], axis=1)
            i = np.concatenate([best_i, np.broadcast_to(b.column(0).to_numpy().astype("i8"), (len(q), b.num_rows))], axis=1)
            order = np.stack([np.lexsort((-i[n], -s[n]))[:k] for n in range(len(q))])
            best_s, best_i = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
        n = best_s.shape[1]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(q)), n)), pa.array(best_i.ravel()), pa.array(best_s.ravel())], names=["qid", "row_id", "score"])

    rows = dense.filter((F.size(vector) == width) & F.forall(vector, lambda v: v.isNotNull())).select(row, vector)
    return rows.mapInArrow(task, "qid bigint, row_id bigint, score double")


def squared_distance(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sum of squared differences of two vectors (col_id, x), without the root."""
    both = a.select("col_id", F.col("x").alias("xa")).join(b.select("col_id", F.col("x").alias("xb")), "col_id", "full")
    d = F.coalesce("xa", F.lit(0.0)) - F.coalesce("xb", F.lit(0.0))
    return both.agg(F.sum(d * d).alias("distance"))


def normalized(queries: DataFrame, how: str = "l2") -> DataFrame:
    """(qid, col_id, x) with sum 1 (``sum``), length 1 (``l2``) or mean 0 (``center``)."""
    from pyspark.sql import Window as W

    w = W.partitionBy("qid")
    x = F.col("x")
    if how == "sum":
        out = x / F.sum("x").over(w)
    elif how == "l2":
        out = x / F.sqrt(F.sum(x * x).over(w))
    elif how == "center":
        out = x - F.avg("x").over(w)
    else:
        raise ValueError(f"unknown norm {how!r}")
    return queries.select("qid", "col_id", out.alias("x"))
