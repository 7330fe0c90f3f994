"""Random matrices and vectors. Every function takes a seed; cells depend on it and on their place alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _uniform(seed: int, salt: int, *of: str) -> Column:
    """U(0, 1) from a hash: never 0, alike on every run and partitioning."""
    return (F.pmod(F.xxhash64(*of, F.lit(seed), F.lit(salt)), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def _normal(seed: int, salt: int, *of: str) -> Column:
    return F.sqrt(-2 * F.ln(_uniform(seed, salt, *of))) * F.cos(2 * 3.141592653589793 * _uniform(seed, salt + 1, *of))


def sparse(spark: SparkSession, rows: int, cols: int, average: int, degrees: str = "uniform", values: str = "normal", seed: int = 0, normalize: bool = True, dedupe: str = "sum", least: int = 1) -> DataFrame:
    """Triples with a random number of entries a row, at random columns.

    degrees: ``uniform`` from average // 2 to int(1.5 * average), or ``gamma`` of shape 3 and mean ``average``, rounded
    down; ``least`` at least. values: ``normal`` or ``uniform01``. Cells drawn twice are summed, or the ``last`` draw
    counts. Rows have length 1 if ``normalize``.
    """
    u = _uniform(seed, 1, "row_id")
    if degrees == "uniform":
        low, high = average // 2, int(1.5 * average)
        degree = F.floor(low + u * (high - low + 1))
    elif degrees == "gamma":  # three exponentials
        degree = F.floor(-(average / 3) * F.ln(u * _uniform(seed, 2, "row_id") * _uniform(seed, 3, "row_id")))
    else:
        raise ValueError(f"unknown degrees {degrees!r}")
    picked = spark.range(rows).withColumnRenamed("id", "row_id").withColumn("degree", F.greatest(F.lit(least), degree).cast("int")).filter("degree > 0")
    drawn = picked.select("row_id", F.explode(F.sequence(F.lit(1), F.col("degree"))).alias("draw"))
    col = F.floor(_uniform(seed, 4, "row_id", "draw") * cols).cast("int")
    val = _normal(seed, 5, "row_id", "draw") if values == "normal" else _uniform(seed, 5, "row_id", "draw")
    cells = drawn.select("row_id", col.alias("col_id"), "draw", val.alias("val")).groupBy("row_id", "col_id")
    out = cells.agg((F.sum("val") if dedupe == "sum" else F.max_by("val", "draw")).alias("val"))
    if normalize:
        out = out.withColumn("val", F.col("val") / F.sqrt(F.sum(F.col("val") * F.col("val")).over(W.partitionBy("row_id"))))
    return out


def masked(spark: SparkSession, rows: int, cols: int, density: float, distribution: str = "uniform", seed: int = 0) -> DataFrame:
    """Triples of a dense draw of which each cell stays with the probability ``density``: uniform(-1, 1), normal, or
    gamma of shape 3 and scale 2."""
    cells = spark.range(rows).select(F.col("id").alias("row_id"), F.explode(F.sequence(F.lit(0), F.lit(cols - 1))).alias("col_id"))
    cells = cells.filter(_uniform(seed, 11, "row_id", "col_id") < density)
    at = ("row_id", "col_id")
    if distribution == "uniform":
        val = _uniform(seed, 12, *at) * 2 - 1
    elif distribution == "normal":
        val = _normal(seed, 12, *at)
    elif distribution == "gamma":
        val = -2 * F.ln(_uniform(seed, 12, *at) * _uniform(seed, 13, *at) * _uniform(seed, 14, *at))
    else:
        raise ValueError(f"unknown distribution {distribution!r}")
    return cells.select("row_id", "col_id", val.alias("val"))


def queries(spark: SparkSession, number: int, cols: int, density: float = 1.0, seed: int = 0) -> DataFrame:
    """(qid, col_id, x): U(-1, 1); with a density, only the cells that stay."""
    cells = spark.range(number).select(F.col("id").alias("qid"), F.explode(F.sequence(F.lit(0), F.lit(cols - 1))).alias("col_id"))
    if density < 1:
        cells = cells.filter(_uniform(seed, 21, "qid", "col_id") < density)
    return cells.select("qid", "col_id", (_uniform(seed, 22, "qid", "col_id") * 2 - 1).alias("x"))


def graph(spark: SparkSession, nodes: int, average: int, seed: int = 0) -> DataFrame:
    """Random edges (src, dst) without loops, each once."""
    drawn = spark.range(nodes).select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(1), F.lit(average))).alias("draw"))
    return drawn.select("src", F.floor(_uniform(seed, 31, "src", "draw") * nodes).cast("bigint").alias("dst")).filter("src <> dst").distinct()


def trials(spark: SparkSession, number: int, rows: int, seed: int = 0) -> DataFrame:
    """(trial, row_id, value): U(0, 1) for every row of every trial."""
    cells = spark.range(number).select(F.col("id").alias("trial"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(rows - 1).cast("bigint"))).alias("row_id"))
    return cells.select("trial", "row_id", _uniform(seed, 41, "trial", "row_id").alias("value"))
