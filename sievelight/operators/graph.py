"""Edge weights and PageRank."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievelight.sources import scratch


def out_degree_weights(edges: DataFrame) -> DataFrame:
    """(src, dst, weight): 1 over the number of edges that leave src."""
    return edges.select("src", "dst", (1.0 / F.count("*").over(W.partitionBy("src"))).alias("weight"))


def pagerank(weights: DataFrame, nodes: DataFrame, alpha: float = 0.85, iterations: int = 20, tolerance: float | None = None) -> DataFrame:
    """(node, rank) after ``iterations`` steps, or when the squared change falls to ``tolerance``.

    rank = alpha * incoming + (1 - alpha) / n + alpha * (rank of nodes without edges) / n. Each step's ranks are a table
    in the shared folder, so lineage stays short and a lost executor costs one step.
    """
    spark = weights.sparkSession
    folder = scratch.folder(spark, "pagerank")
    nodes = nodes.select("node").distinct()
    weights.write.parquet(f"{folder}/weights")
    weights = spark.read.parquet(f"{folder}/weights")
    leaves = weights.select(F.col("src").alias("node")).distinct().withColumn("leads", F.lit(True))
    nodes.join(leaves, "node", "left").select("node", F.coalesce("leads", F.lit(False)).alias("leads")).write.parquet(f"{folder}/nodes")
    nodes = spark.read.parquet(f"{folder}/nodes")
    n = nodes.count()
    ranks = nodes.select("node", "leads", F.lit(1.0 / max(1, n)).alias("rank"))
    for i in range(iterations):
        lost = ranks.agg(F.sum(F.when(~F.col("leads"), F.col("rank")).otherwise(0.0)).alias("lost")).first()["lost"] or 0.0
        given = weights.join(ranks.select(F.col("node").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("weight") * F.col("rank")).alias("given"))
        new = ranks.withColumnRenamed("rank", "old").join(given, "node", "left")
        base = (1 - alpha) / max(1, n) + alpha * lost / max(1, n)
        new = new.select("node", "leads", (alpha * F.coalesce("given", F.lit(0.0)) + base).alias("rank"), "old")
        new.write.parquet(f"{folder}/step-{i}")
        new = spark.read.parquet(f"{folder}/step-{i}")
        if tolerance is not None and (new.agg(F.sum((F.col("rank") - F.col("old")) ** 2).alias("e")).first()["e"] or 0.0) <= tolerance:
            return new.select("node", "rank")
        ranks = new.select("node", "leads", "rank")
    return ranks.select("node", "rank")
