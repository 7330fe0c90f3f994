"""Quality of ranked lists: ``gold`` and ``test`` are (qid, rank, row_id, score), rank from 1."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Depths at which precision is reported; a depth weighs its reciprocal in the convergence metric.
DEPTHS = (1, 8, 16, 32, 50, 75, 100)


def precision(gold: DataFrame, found: DataFrame, depths: tuple[int, ...] = DEPTHS) -> DataFrame:
    """(qid, k, precision): share of the gold list's first k among ``found`` (qid, row_id)."""
    ks = F.broadcast(gold.sparkSession.createDataFrame([(k,) for k in depths], "k int"))  # len(depths) rows
    hit = gold.join(found.select("qid", "row_id", F.lit(1).alias("hit")).distinct(), ["qid", "row_id"], "left")
    return hit.join(ks, F.col("rank") <= F.col("k")).groupBy("qid", "k").agg((F.sum(F.coalesce("hit", F.lit(0))) / F.col("k")).alias("precision"))


def summary(precisions: DataFrame) -> DataFrame:
    """(k, avg_precision, recall): recall is the share of queries whose whole list was found."""
    return precisions.groupBy("k").agg(F.avg("precision").alias("avg_precision"), F.avg((F.col("precision") == 1).cast("double")).alias("recall"))


def convergence(summaries: DataFrame) -> DataFrame:
    """One number: average precisions weighted by 1/k."""
    return summaries.agg(F.sum(F.col("avg_precision") / F.col("k")).alias("metric"))


def ndcg_by_value(gold: DataFrame, test: DataFrame) -> DataFrame:
    """(qid, ndcg): the gain of a listed row is its gold score if it is in the gold list, else 0."""
    gain = lambda rank: 1 / F.log2(rank + 1)
    ideal = gold.groupBy("qid").agg(F.sum(F.col("score") * gain(F.col("rank"))).alias("ideal"))
    got = test.select("qid", "rank", "row_id").join(gold.select("qid", "row_id", "score"), ["qid", "row_id"]).groupBy("qid").agg(F.sum(F.col("score") * gain(F.col("rank"))).alias("got"))
    return ideal.join(got, "qid", "left").select("qid", (F.coalesce("got", F.lit(0.0)) / F.col("ideal")).alias("ndcg"))


def ndcg_by_rank(gold: DataFrame, test: DataFrame, n: int | None = None) -> DataFrame:
    """(qid, ndcg) over the first ``n`` places: a row's gain falls with its place in the test list, n for the first; the
    discount is that of its place in the gold list."""
    if n is not None:
        gold, test = gold.filter(F.col("rank") <= n), test.filter(F.col("rank") <= n)
    size = gold.groupBy("qid").agg(F.max("rank").alias("size"))
    gold = gold.join(size, "qid")
    share = 1 / F.log2(F.col("rank") + 1)
    ideal = gold.groupBy("qid").agg(F.sum((F.col("size") - F.col("rank") + 1) * share).alias("ideal"))
    own = test.select("qid", "row_id", F.col("rank").alias("place"))
    got = gold.join(own, ["qid", "row_id"]).groupBy("qid").agg(F.sum((F.col("size") - F.col("place") + 1) * share).alias("got"))
    return ideal.join(got, "qid", "left").select("qid", (F.coalesce("got", F.lit(0.0)) / F.col("ideal")).alias("ndcg"))


def edit_distance(gold: DataFrame, test: DataFrame, n: int, indel: int = 1) -> DataFrame:
    """(qid, distance): Levenshtein's distance of the two lists' first ``n`` ids. A replaced id costs 1, an id put in or
    left out costs ``indel``, 1 or 2. Each id of a query becomes one character, after one that all share where ``indel``
    is 2, so this holds for lists of a few thousand ids."""
    if indel not in (1, 2):
        raise ValueError(f"indel must be 1 or 2, not {indel}")
    both = gold.filter(F.col("rank") <= n).select("qid", "rank", "row_id", F.lit(0).alias("which")).unionByName(test.filter(F.col("rank") <= n).select("qid", "rank", "row_id", F.lit(1).alias("which")))
    coded = both.withColumn("c", F.expr("decode(unhex(lpad(hex(256 + dense_rank() over (partition by qid order by row_id)), 4, '0')), 'UTF-16BE')"))
    if indel == 2:
        coded = coded.withColumn("c", F.concat(F.lit("-"), "c"))
    text = lambda w: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("which") == w, F.struct("rank", "c")))), lambda e: e["c"]), "")
    return coded.groupBy("qid").agg(text(0).alias("a"), text(1).alias("b")).select("qid", F.levenshtein("a", "b").alias("distance"))


def positions_differ(gold: DataFrame, test: DataFrame, n: int) -> DataFrame:
    """(qid, errors): places among the first ``n`` that hold different ids, or an id in one list only."""
    a = gold.filter(F.col("rank") <= n).select("qid", "rank", F.col("row_id").alias("a"))
    b = test.filter(F.col("rank") <= n).select("qid", "rank", F.col("row_id").alias("b"))
    return a.join(b, ["qid", "rank"], "full").groupBy("qid").agg(F.sum((~F.col("a").eqNullSafe(F.col("b"))).cast("bigint")).alias("errors"))


def swap_errors(gold: DataFrame, test: DataFrame) -> DataFrame:
    """(qid, errors): places with different ids, where two neighbours that changed places count once."""
    both = gold.select("qid", "rank", F.col("row_id").alias("a")).join(test.select("qid", "rank", F.col("row_id").alias("b")), ["qid", "rank"])
    w = W.partitionBy("qid").orderBy("rank")
    swap = (F.col("a") != F.col("b")) & (F.col("a") == F.lag("b").over(w)) & (F.col("b") == F.lag("a").over(w))
    return both.withColumn("second", F.coalesce(swap, F.lit(False))).groupBy("qid").agg(F.sum(((F.col("a") != F.col("b")) & ~F.col("second")).cast("bigint")).alias("errors"))


def mismatches(a: DataFrame, b: DataFrame, key: list[str], value: str, tolerance: float) -> DataFrame:
    """One row: values that differ by more than ``tolerance``; a value in one table only differs."""
    both = a.select(*key, F.col(value).alias("x")).join(b.select(*key, F.col(value).alias("y")), key, "full")
    return both.agg(F.sum(F.coalesce(F.abs(F.col("x") - F.col("y")) > tolerance, F.lit(True)).cast("bigint")).alias("mismatches"), F.count("*").alias("compared"))


def run_stats(runs: DataFrame, value: str, skip: int) -> DataFrame:
    """Mean and population deviation of ``value`` over the runs from ``skip`` on (column ``run``)."""
    return runs.filter(F.col("run") >= skip).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("st_dev"))


def gold_places(gold: DataFrame, test: DataFrame, missing: int = 1000) -> DataFrame:
    """(qid, rank, row_id, place): where each gold row stands in the test list; ``missing`` if nowhere."""
    own = test.select("qid", "row_id", F.col("rank").alias("place"))
    return gold.join(own, ["qid", "row_id"], "left").select("qid", "rank", "row_id", F.coalesce("place", F.lit(missing)).alias("place"))
