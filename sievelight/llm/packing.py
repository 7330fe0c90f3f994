"""Harmonic packing of token sequences.

A length L belongs to class k when capacity/(k+1) < L <= capacity/k; a bin of class k takes exactly k pieces. Each
task numbers its own pieces of every class; a table of one count per task and class turns these into places, so all
bins are filled independently. What is left over, under k pieces a class, is a bounded number of pieces and is packed
first-fit decreasing.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelight.llm import common, tokenization

#: Broadcast the table of counts up to this many rows (about 32 bytes each); join it by shuffling beyond.
BROADCAST_ROWS = 100_000


def cut(n: int, capacity: int, grain: int) -> list[int]:
    """Lengths of a document's pieces: whole bins, then halves, quarters and so on down to ``grain``, then the rest."""
    out = [capacity] * (n // capacity)
    n %= capacity
    size = capacity // 2
    while size >= grain and n:
        if n >= size:
            out.append(size)
            n -= size
        size //= 2
    return out + [n] * (n > 0)


def first_fit(lengths: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each length; the longest go first, each into the first bin that has room."""
    room: list[int] = []
    out = [(0, 0)] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        k = next((k for k, r in enumerate(room) if r >= lengths[i]), len(room))
        if k == len(room):
            room.append(capacity)
        out[i] = (k, capacity - room[k])
        room[k] -= lengths[i]
    return out


_PIECES = common.schema(doc_id="long", start="long", length="long", ids_crc32="long", doc_tokens="long", klass="int", part="int", n="long")
_PIECES_ARROW = pa.schema([(f.name, pa.int32() if f.dataType.simpleString() == "int" else pa.int64()) for f in _PIECES])
_OUT = [*_PIECES.names[:5], "sequence_id", "offset", "klass"]


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, grain: int, cached: int = tokenization.CACHED) -> DataFrame:
    """One row per piece of each document (doc_id, text), numbered by task (part) and class; stored, as a lost task's
    numbers must not change. Null text counts as empty; other columns are ignored; repeated rows stay apart."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, end, seen = TaskContext.get().partitionId(), end_id.to_bytes(4, "little"), Counter()
        for b in batches:
            for i in range(0, b.num_rows, 256):
                own = b.slice(i, 256)
                rows: list[tuple] = []
                for d, ids in zip(own.column(0).to_pylist(), tokenization.encoder(tokenizer, cached).encode(own.column(1).to_pylist()), strict=True):
                    view, at = memoryview(ids + end), 0
                    n = len(view) // 4
                    for size in cut(n, capacity, grain):
                        k = capacity // size
                        rows.append((d, at, size, zlib.crc32(view[4 * at : 4 * (at + size)]), n, k, part, seen[k]))
                        seen[k] += 1
                        at += size
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _PIECES_ARROW, strict=True)], schema=_PIECES_ARROW)
        common.trim()

    common.ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return common.stored(rows.mapInArrow(task, _PIECES), "pieces", keep=True)  # the result reads it later


def pack(docs: DataFrame, tokenizer: str | None = None, end_id: int = 0, capacity: int = 1024, grain: int = 64, cached: int = tokenization.CACHED) -> DataFrame:
    """Place the tokens of all ``docs`` into sequences of at most ``capacity`` tokens (a power of two). ``cached``: pieces
    of text that a worker remembers; fewer take less memory and more time.

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id (gapless from 0), offset, klass. An empty table
    gives no rows; an empty or null text has its end token alone.
    """
    from pyspark.sql import Window as W

    if capacity & (capacity - 1) or grain & (grain - 1) or not 1 <= grain <= capacity:
        raise ValueError("capacity and grain must be powers of two, grain no larger than capacity")
    spark = docs.sparkSession
    rows = pieces(docs, tokenizer or tokenization.default_path(), end_id, capacity, grain, cached)
    counts = rows.groupBy("klass", "part").count()
    totals = {r["klass"]: (r["n"], r["parts"]) for r in counts.groupBy("klass").agg(F.sum("count").alias("n"), F.count("*").alias("parts")).collect()}  # one row a class
    base, bins = 0, []
    for k, (n, _) in sorted(totals.items()):
        bins.append((k, n // k, base))
        base += n // k
    by_class = spark.createDataFrame(bins, common.schema(klass="int", full="long", base="long"))
    before = counts.withColumn("before", F.sum("count").over(W.partitionBy("klass").orderBy("part")) - F.col("count")).drop("count")
    before = before.join(F.broadcast(by_class), "klass")  # a row a class: capacity rows at most
    if sum(p for _, p in totals.values()) <= BROADCAST_ROWS:
        before = F.broadcast(before)
    placed = rows.join(before, ["klass", "part"]).withColumn("rank", F.col("before") + F.col("n")).withColumn("bin", F.expr("rank div klass"))
    filled = placed.filter("bin < full").withColumn("sequence_id", F.col("base") + F.col("bin"))
    # classes below capacity/grain hold one length only, so a place is known without its neighbours
    alike = filled.filter(F.col("klass") < capacity // grain).withColumn("offset", F.col("rank") % F.col("klass") * F.col("length"))
    w = W.partitionBy("sequence_id").orderBy("rank")  # at most klass rows
    mixed = filled.filter(F.col("klass") >= capacity // grain).withColumn("offset", F.sum("length").over(w) - F.col("length"))

    def left_over(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["klass", "rank"], ignore_index=True)
        at = first_fit(pdf["length"].tolist(), capacity)
        return pdf.assign(sequence_id=[base + k for k, _ in at], offset=[o for _, o in at])[_OUT]

    # under k pieces of each class k that occurs, however large the input
    rest = placed.filter("bin >= full").withColumn("all", F.lit(0)).groupBy("all").applyInPandas(left_over, common.schema(**dict.fromkeys(_OUT[:-1], "long"), klass="int"))
    return alike.select(_OUT).unionByName(mixed.select(_OUT)).unionByName(rest.select(_OUT))
