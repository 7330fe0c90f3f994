"""Word-vector text: ``token f1 f2 ...`` a line, with or without a first line ``count dimension``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def read(spark: SparkSession, path: str) -> DataFrame:
    """(row_id, token, embedding): row_id counts the vectors in the order of the file from 0.

    Lines of two fields are header lines and left out. Ids come from each block's own order and the number of lines in
    the blocks before it, so no task sees the whole file.
    """
    lines = spark.read.text(path).select("value", F.input_file_name().alias("file"), F.input_file_block_start().alias("block"), F.monotonically_increasing_id().alias("n"))
    words = F.split(F.trim("value"), r"\s+")
    lines = lines.select("file", "block", "n", words.alias("w")).filter(F.size("w") > 2)
    sizes = lines.groupBy("file", "block").count()
    before = sizes.select("file", "block", (F.sum("count").over(W.orderBy("file", "block")) - F.col("count")).alias("before"))  # a row a block
    own = F.row_number().over(W.partitionBy("file", "block").orderBy("n")) - 1
    vector = F.transform(F.slice("w", 2, F.size("w") - 1), lambda x: x.cast("double"))
    return lines.withColumn("own", own).join(F.broadcast(before), ["file", "block"]).select((F.col("before") + F.col("own")).cast("bigint").alias("row_id"), F.col("w")[0].alias("token"), vector.alias("embedding"))


def write(table: DataFrame, path: str) -> None:
    """Text lines of (token, embedding)."""
    table.select(F.concat_ws(" ", "token", F.transform("embedding", lambda x: x.cast("string"))).alias("value")).write.text(path)
