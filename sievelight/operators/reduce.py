"""Pruning and quantising matrices given as triples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievelight.functions import quantized


def one_row(df: DataFrame) -> DataFrame:
    """Marks an ungrouped aggregate, which is always one row, for a broadcast."""
    return F.broadcast(df)


def prune(triples: DataFrame, ratio: float, mean: str = "nonzero", cells: int | None = None) -> DataFrame:
    """Keep the ceil(entries * ratio) entries of each row that are largest in size; ties go to the lower column.

    A row whose smallest entry exceeds the matrix's mean size is kept whole. ``mean``: over the entries (``nonzero``) or
    over all ``cells`` of the matrix (``cells``).
    """
    size = F.abs("val")
    entries = triples.filter("val <> 0")
    if mean == "nonzero":
        average = entries.agg(F.avg(size).alias("mean"))
    elif mean == "cells":
        average = entries.agg((F.sum(size) / F.lit(float(cells))).alias("mean"))
    else:
        raise ValueError(f"unknown mean {mean!r}")
    row = W.partitionBy("row_id")
    ranked = entries.withColumn("n", F.count("*").over(row)).withColumn("least", F.min(size).over(row)).withColumn("place", F.row_number().over(row.orderBy(F.desc(size), "col_id")))
    kept = ranked.join(one_row(average), how="cross").filter((F.col("place") <= F.ceil(F.col("n") * F.lit(float(ratio)))) | (F.col("least") > F.col("mean")))
    return kept.select("row_id", "col_id", "val")


def quantize(triples: DataFrame, bits: int = 6, scheme: str = "dense", symmetric: bool = True, drop_zeros: bool | None = None) -> DataFrame:
    """(row_id, col_id, q) by the matrix's largest size; the csr scheme drops zeros unless told otherwise."""
    largest = one_row(triples.agg(F.max(F.abs("val")).alias("largest")))
    out = triples.join(largest, how="cross").select("row_id", "col_id", quantized(F.col("val"), F.col("largest"), bits, scheme, symmetric).alias("q"))
    return out.filter("q <> 0") if (scheme == "csr" if drop_zeros is None else drop_zeros) else out


def quantize_queries(queries: DataFrame, bits: int = 6, scheme: str = "dense", symmetric: bool = True) -> DataFrame:
    """(qid, col_id, q) of (qid, col_id, x), each query by its own largest size; a query of zeros stays zero."""
    largest = F.max(F.abs("x")).over(W.partitionBy("qid"))
    return queries.withColumn("largest", largest).select("qid", "col_id", F.when(F.col("largest") == 0, 0).otherwise(quantized(F.col("x"), F.col("largest"), bits, scheme, symmetric)).alias("q"))


def fill_empty_rows(q: DataFrame, rows: DataFrame, column: Column, value: str = "q") -> DataFrame:
    """Rows of ``rows`` (row_id) without a non-zero entry get the value 1 at ``column``."""
    live = q.filter(F.col(value) != 0).select("row_id").distinct()
    missing = rows.select("row_id").distinct().join(live, "row_id", "left_anti")
    one = F.lit(1).cast(q.schema[value].dataType)
    return q.select("row_id", "col_id", value).unionByName(missing.select("row_id", column.cast("int").alias("col_id"), one.alias(value)))
