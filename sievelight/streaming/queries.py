"""Queries as a stream: every micro-batch of (qid, col_id, x) meets the stored matrix."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from sievelight.operators import score, topk


def topk_batches(triples: DataFrame, k: int, sink: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: hands each batch's top-k lists and number to ``sink``. A batch that is run again has the same
    number, so a sink that overwrites by number writes each batch once."""

    def run(batch: DataFrame, number: int) -> None:
        sink(topk.topk(score.multiply(triples, batch), k), number)

    return run


def answer_stream(queries: DataFrame, triples: DataFrame, k: int, out: str, checkpoint: str) -> StreamingQuery:
    """Answer all that ``queries`` has, into Parquet folders ``out/batch=N``."""

    def sink(lists: DataFrame, number: int) -> None:
        lists.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return queries.writeStream.foreachBatch(topk_batches(triples, k, sink)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
