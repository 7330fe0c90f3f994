"""Result logs and run reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lines such as "K=8   avg_precision:99.5%  recall=40.0%", with the key spelt either way.
_LINE = r"K\s*=\s*(\d+)\s+avg_precisi?on\s*:\s*([0-9.]+)%\s*recall\s*[=:]\s*([0-9.]+)%"


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """(file, k, avg_precision, recall) of all result lines, as shares of 1."""
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), "value").filter(F.col("value").rlike(_LINE))
    part = lambda i: F.regexp_extract("value", _LINE, i)
    return lines.select("file", part(1).cast("int").alias("k"), (part(2).cast("double") / 100).alias("avg_precision"), (part(3).cast("double") / 100).alias("recall"))


def write_report(runs: DataFrame, path: str) -> None:
    """CSV with a header; array columns are joined by semicolons."""
    flat = [F.array_join(F.transform(c, lambda x: x.cast("string")), ";").alias(c) if t.startswith("array") else F.col(c) for c, t in runs.dtypes]
    runs.select(*flat).write.option("header", True).csv(path)


def read_column_files(spark: SparkSession, values: str, pointers: str, indices: str) -> DataFrame:
    """Triples of compressed columns in three text files of one number a line: values, column starts, row indices."""
    from pyspark.sql import Window as W

    def numbered(path: str, kind: str) -> DataFrame:
        lines = spark.read.text(path).select(F.input_file_block_start().alias("block"), F.monotonically_increasing_id().alias("n"), F.trim("value").cast(kind).alias("v")).filter("v is not null")
        sizes = lines.groupBy("block").count()
        before = sizes.select("block", (F.sum("count").over(W.orderBy("block")) - F.col("count")).alias("before"))  # a row a block
        own = F.row_number().over(W.partitionBy("block").orderBy("n")) - 1
        return lines.withColumn("own", own).join(F.broadcast(before), "block").select((F.col("before") + F.col("own")).cast("bigint").alias("at"), "v")

    ends = numbered(pointers, "bigint")
    spans = ends.select((F.col("at")).cast("int").alias("col_id"), F.col("v").alias("begin")).join(ends.select((F.col("at") - 1).cast("int").alias("col_id"), F.col("v").alias("end")), "col_id")
    places = spans.filter("end > begin").select("col_id", F.explode(F.sequence(F.col("begin"), F.col("end") - 1)).alias("at"))
    return places.join(numbered(indices, "bigint").withColumnRenamed("v", "row_id"), "at").join(numbered(values, "double").withColumnRenamed("v", "val"), "at").select("row_id", "col_id", "val")
