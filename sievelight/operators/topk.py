"""The best k rows of each query, of all rows or part by part. Ties: the larger row_id is better."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievelight.operators import layout


def topk(scores: DataFrame, k: int, ascending: bool = False, least: float | None = None) -> DataFrame:
    """(qid, rank, row_id, score), rank from 1. ``least``: scores at or below it never enter."""
    rows = scores if least is None else scores.filter(F.col("score") > least)
    order = (F.asc("score"), F.asc("row_id")) if ascending else (F.desc("score"), F.desc("row_id"))
    ranked = rows.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy(*order)))
    return ranked.filter(F.col("rank") <= k).select("qid", "rank", "row_id", "score")


def candidates(scores: DataFrame, part: Column, parts: int, ck: int, keep: str = "score") -> DataFrame:
    """The best ``ck // parts`` rows of every part: (qid, part, row_id, score)."""
    if ck < parts:
        raise ValueError(f"{ck} candidates cannot come from {parts} parts")
    w = W.partitionBy("qid", "part").orderBy(F.desc(keep), F.desc("row_id"))
    ranked = scores.withColumn("part", part).withColumn("n", F.row_number().over(w))
    return ranked.filter(F.col("n") <= ck // parts).select("qid", "part", "row_id", "score")


def lane_candidates(triples: DataFrame, scores: DataFrame, part: Column, lanes: int = 30, keep: int = 8) -> DataFrame:
    """Candidates of hardware with two result lanes a part: of each packet of ``lanes`` entries only two finished rows
    are offered, the one carried over from the packet before (lane 0) and the first that starts in it (lane 1); each
    lane keeps its ``keep`` best. Rows are offered in the packet where they end."""
    placed = layout.placed(triples, part, lanes)
    rows = placed.groupBy("part", "row_id").agg(F.min("pkt").alias("first"), F.max("pkt").alias("pkt"))
    carried = (F.col("first") < F.col("pkt")).cast("int")
    place = F.row_number().over(W.partitionBy("part", "pkt", "carried").orderBy("row_id"))
    offered = rows.withColumn("carried", carried).withColumn("place", place).filter("place = 1")
    offered = offered.select("part", "row_id", (1 - F.col("carried")).alias("lane"))
    w = W.partitionBy("qid", "part", "lane").orderBy(F.desc("score"), F.desc("row_id"))
    return scores.join(offered, "row_id").withColumn("n", F.row_number().over(w)).filter(F.col("n") <= keep).select("qid", "part", "lane", "row_id", "score")


def merged_precision(values: DataFrame, rows: int, parts: int, kept: int, depths: tuple[int, ...]) -> DataFrame:
    """(trial, k, precision): share of each trial's best k of (trial, row_id, value) that is among the ``kept`` best of
    its balanced part."""
    scores = values.select(F.col("trial").alias("qid"), "row_id", F.col("value").alias("score"))
    best = topk(scores, max(depths)).select("qid", "row_id", "rank")
    found = candidates(scores, layout.split_of(F.col("row_id"), rows, parts, "balanced"), parts, kept * parts).select("qid", "row_id", F.lit(1).alias("hit"))
    ks = F.broadcast(values.sparkSession.createDataFrame([(k,) for k in depths], "k int"))  # len(depths) rows
    hits = best.join(found, ["qid", "row_id"], "left").join(ks, F.col("rank") <= F.col("k"))
    return hits.groupBy(F.col("qid").alias("trial"), "k").agg((F.sum(F.coalesce("hit", F.lit(0))) / F.col("k")).alias("precision"))
