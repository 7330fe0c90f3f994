"""Matrices and queries made from the test tables, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelight.operators import layout

#: Columns of the sparse matrix that is made from ``lineitem``.
SPARSE_COLS = 512


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("row_id"), "embedding")


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.to_triples(dense(spark, sf_dir))


def line_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by part number modulo SPARSE_COLS; cells repeat."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return rows.select(F.col("l_orderkey").alias("row_id"), (F.col("l_partkey") % SPARSE_COLS).cast("int").alias("col_id"), F.col("l_quantity").alias("val"), "l_linenumber")


def sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.deduplicated(line_cells(spark, sf_dir).drop("l_linenumber"))


def asked(number: int | None) -> Column:
    """Which rows of the dense matrix are queries: the first ``number``, or with None the query set of searches, every
    row whose id is divisible by 100."""
    return F.col("row_id") < number if number is not None else F.col("row_id") % 100 == 0


def queries(spark: SparkSession, sf_dir: str, number: int | None) -> DataFrame:
    """The rows of the dense matrix that ``asked`` tells as (qid, col_id, x)."""
    return triples(spark, sf_dir).filter(asked(number)).select(F.col("row_id").alias("qid"), "col_id", F.col("val").alias("x"))


def cells(spark: SparkSession, sf_dir: str, number: int | None) -> int:
    """How many rows ``queries`` has, counted where the number of queries is not given."""
    return 64 * number if number is not None else queries(spark, sf_dir, None).count()


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers and part numbers modulo 50, as nodes of one graph; loops and repeats occur."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return rows.select((F.col("l_suppkey") % 60).alias("src"), (F.col("l_partkey") % 50).alias("dst"))


CTE = {
    "coo": "coo AS (SELECT vec_id AS row_id, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS col_id, CAST(unnest(embedding) AS DOUBLE) AS val FROM embeddings)",
    "sp": f"sp AS (SELECT l_orderkey AS row_id, CAST(l_partkey % {SPARSE_COLS} AS INTEGER) AS col_id, sum(l_quantity) AS val FROM lineitem GROUP BY ALL)",
    "edges": "edges AS (SELECT l_suppkey % 60 AS src, l_partkey % 50 AS dst FROM lineitem)",
}
CTE |= {f"x{n}": f"x{n} AS (SELECT row_id AS qid, col_id, val AS x FROM coo WHERE row_id < {n})" for n in (1, 3, 5, 100)}


def sql(names: str, body: str) -> str:
    return f"WITH {', '.join(CTE.get(n, n) for n in names.split())} {body}"


def hundredths(text: str) -> str:
    """SQL over the first vectors as queries, over every vector whose id is divisible by 100 instead."""
    for n in (1, 3, 5):
        text = text.replace(CTE[f"x{n}"], CTE[f"x{n}"].replace(f"row_id < {n}", "row_id % 100 = 0"))
    return text
