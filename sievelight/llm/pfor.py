"""Token ids in binary files of patched frame-of-reference blocks.

A file holds ids in document order::

    magic, block length (u32), ids (u64), documents (u32)
    blocks: packed deltas, then exceptions (positions u16, high parts u32)
    index: block starts (u64), minima (u32), widths (u8), exceptions (u16); documents: id (i64), null (u8), length (u64)
    footer: index start (u64), magic

Each block subtracts its minimum, packs the deltas' low bits at the width that the ``percentile`` of its deltas needs,
and lists what does not fit: position and the bits above the width.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelight.llm import common, tokenization

MAGIC = b"SVPFOR1\0"
_HEAD, _FOOT = struct.Struct("<8sIQI"), struct.Struct("<Q8s")
#: Ids that a reading task takes, so that many small files make few tasks and few files of what is read.
TASK_IDS = 1 << 25


def encode_blocks(ids: np.ndarray, block: int = 512, percentile: float = 0.95) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Payloads, minima, widths and numbers of exceptions of the blocks that hold ``ids`` (the last is filled up)."""
    n = -(-len(ids) // block)
    if not n:
        return [], np.zeros(0, "<u4"), np.zeros(0, "u1"), np.zeros(0, "<u2")
    grid = np.empty(n * block, "<u4")
    grid[: len(ids)], grid[len(ids) :] = ids, ids[-1]
    grid = grid.reshape(n, block)
    low = grid.min(axis=1)
    delta = grid - low[:, None]
    at = min(block - 1, max(0, int(np.ceil(percentile * block)) - 1))
    width = np.frexp(np.partition(delta, at, axis=1)[:, at].astype("f8"))[1].astype("u1")
    packed: list[bytes] = [b""] * n
    counts = np.zeros(n, "<u2")
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        part = delta[rows]
        bits = np.unpackbits(part.view("u1").reshape(len(rows), block, 4), axis=2, bitorder="little", count=int(w)) if w else None
        body = np.packbits(bits.reshape(len(rows), -1), axis=1, bitorder="little") if w else np.zeros((len(rows), 0), "u1")
        high = part >> np.uint32(w) if w < 32 else np.zeros_like(part)
        r, pos = np.nonzero(high)
        ends = np.searchsorted(r, np.arange(len(rows) + 1))
        over = high[r, pos].astype("<u4")
        for i, k in enumerate(rows):
            a, b = ends[i], ends[i + 1]
            counts[k] = b - a
            packed[k] = body[i].tobytes() + pos[a:b].astype("<u2").tobytes() + over[a:b].tobytes()
    return packed, low.astype("<u4"), width, counts


def decode_blocks(data: memoryview, starts: np.ndarray, low: np.ndarray, width: np.ndarray, counts: np.ndarray, block: int) -> np.ndarray:
    """The ids of whole blocks; ``starts`` count from the start of ``data``."""
    n = len(starts)
    out = np.empty((n, block), "<u4")
    raw = np.frombuffer(data, "u1")
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        size = int(w) * block // 8
        if w:
            body = np.zeros((len(rows), size + 8), "u1")
            body[:, :size] = raw[starts[rows].astype("i8")[:, None] + np.arange(size)]
            bit = np.arange(block) * int(w)
            kind = "u4" if w <= 25 else "u8"  # holds the bytes that one value touches
            value = np.zeros((len(rows), block), kind)
            for k in range((int(w) + 14) // 8):
                value |= body[:, (bit >> 3) + k].astype(kind) << np.array(8 * k, kind)
            out[rows] = (value >> (bit & 7).astype(kind)) & np.array((1 << int(w)) - 1, kind)
        else:
            out[rows] = 0
        for k in rows[counts[rows] > 0]:
            at, c = int(starts[k]) + size, int(counts[k])
            pos = raw[at : at + 2 * c].view("<u2") if at % 2 == 0 else np.frombuffer(raw[at : at + 2 * c].tobytes(), "<u2")
            high = np.frombuffer(raw[at + 2 * c : at + 6 * c].tobytes(), "<u4")
            out[k, pos] |= high << np.uint32(w)
    return (out + low[:, None]).astype("<u4").reshape(-1)


class Writer:
    """Appends documents' ids to one file; holds ``chunk`` ids at most and the index."""

    def __init__(self, stream, block: int = 512, percentile: float = 0.95, chunk: int = 1 << 20):
        self.out, self.block, self.percentile = stream, block, percentile
        self.chunk = -(-chunk // block) * block
        self.held: list[np.ndarray] = []
        self.n_held = self.n_ids = 0
        self.at = _HEAD.size
        self.index: list[tuple[np.ndarray, ...]] = []
        self.docs: list[tuple[int | None, int]] = []
        self.out.write(_HEAD.pack(MAGIC, block, 0, 0))  # the true counts stand in the index

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, len(ids)))
        self.held.append(ids)
        self.n_held += len(ids)
        self.n_ids += len(ids)
        if self.n_held >= self.chunk:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, "<u4")
        whole = len(ids) if last else len(ids) // self.block * self.block
        packed, low, width, counts = encode_blocks(ids[:whole], self.block, self.percentile)
        sizes = np.array([len(x) for x in packed], "<u8")
        self.index.append((self.at + np.cumsum(sizes) - sizes, low, width, counts))
        self.out.write(b"".join(packed))
        self.at += int(sizes.sum())
        self.held = [ids[whole:]]
        self.n_held = len(ids) - whole

    def close(self) -> None:
        self._flush(True)
        starts, low, width, counts = (np.concatenate(x) for x in zip(*self.index, strict=True))
        for x, kind in ((starts, "<u8"), (low, "<u4"), (width, "u1"), (counts, "<u2")):
            self.out.write(x.astype(kind).tobytes())
        self.out.write(np.array([d or 0 for d, _ in self.docs], "<i8").tobytes())
        self.out.write(np.array([d is None for d, _ in self.docs], "u1").tobytes())
        self.out.write(np.array([n for _, n in self.docs], "<u8").tobytes())
        self.out.write(struct.pack("<QQQ", len(starts), self.n_ids, len(self.docs)))
        self.out.write(_FOOT.pack(self.at, MAGIC))
        self.out.close()


class Reader:
    """Random access to one file: ``docs`` and ``read(start, n)``."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        head = _HEAD.unpack(self._at(0, _HEAD.size))
        index_at, magic = _FOOT.unpack(self._at(size - _FOOT.size, _FOOT.size))
        if head[0] != MAGIC or magic != MAGIC:
            raise ValueError("not a file of patched frame-of-reference blocks")
        tail = memoryview(self._at(index_at, size - _FOOT.size - index_at))
        n, self.n_ids, n_docs = struct.unpack("<QQQ", tail[-24:])
        self.block, self.end, at = head[1], index_at, 0
        parts = []
        for kind, k in (("<u8", n), ("<u4", n), ("u1", n), ("<u2", n), ("<i8", n_docs), ("u1", n_docs), ("<u8", n_docs)):
            parts.append(np.frombuffer(tail[at : at + np.dtype(kind).itemsize * k], kind))
            at += np.dtype(kind).itemsize * k
        self.starts, self.low, self.width, self.counts, self.doc_ids, self.nulls, self.lengths = parts

    def _at(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def read(self, start: int, n: int) -> np.ndarray:
        """Ids ``start`` to ``start + n`` of the file."""
        n = min(n, self.n_ids - start)
        if n <= 0:
            return np.zeros(0, "<u4")
        a, b = start // self.block, -(-(start + n) // self.block)
        first, last = int(self.starts[a]), int(self.starts[b]) if b < len(self.starts) else self.end
        ids = decode_blocks(memoryview(self._at(first, last - first)), self.starts[a:b] - first, self.low[a:b], self.width[a:b], self.counts[a:b], self.block)
        return ids[start - a * self.block :][:n]

    def documents(self, chunk: int = 1 << 20) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, start in the file, ids), in file order; about ``chunk`` ids are decoded at a time."""
        start, held, held_at = 0, np.zeros(0, "<u4"), 0
        for d, null, n in zip(self.doc_ids.tolist(), self.nulls.tolist(), self.lengths.tolist(), strict=True):
            if start + n > held_at + len(held):
                held, held_at = self.read(start, max(chunk, n)), start
            yield (None if null else d), start, held[start - held_at : start - held_at + n]
            start += n


def write(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = 2, block: int = 512, percentile: float = 0.95) -> DataFrame:
    """Write the ids of all ``docs`` (doc_id, text) below ``folder``; return the files' table, read from the folder.

    The table: part, path, n_ids, n_docs; parts ascend as doc_id does (null first, ties by the text's hash). Every document ends
    with ``end_id``; null text counts as empty, so it has that id alone. Other columns are ignored. A repeated task
    writes a file of another name, and the table names only files of tasks that succeeded.
    """
    tokenizer = tokenizer or tokenization.default_path()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as pafs
        from pyspark import TaskContext

        part, end = TaskContext.get().partitionId(), np.array([end_id], "<u4").tobytes()
        store, base = pafs.FileSystem.from_uri(f"{folder}/files")
        out, path = None, f"{base}/{part:08d}-{uuid.uuid4().hex}.pfor"
        for b in batches:
            for i in range(0, b.num_rows, 256):
                own = b.slice(i, 256)
                if out is None:
                    store.create_dir(base, recursive=True)
                    out = Writer(store.open_output_stream(path), block, percentile)
                for d, ids in zip(own.column(0).to_pylist(), tokenization.encoder(tokenizer).encode(own.column(1).to_pylist()), strict=True):
                    out.add(d, np.frombuffer(ids + end, "<u4"))
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "path": [path], "n_ids": [out.n_ids], "n_docs": [len(out.docs)]}, _FILES_ARROW)

    common.ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    place = F.xxhash64("text")  # rows of one id, or without one, may be many: they are dealt out as well
    ordered = rows.repartitionByRange("doc_id", place).sortWithinPartitions("doc_id", place, "text")
    files = ordered.mapInArrow(task, _FILES).toArrow()  # one row a file; written from each task, they would be as many files
    docs.sparkSession.createDataFrame(files).coalesce(1).write.parquet(f"{folder}/table")
    return docs.sparkSession.read.schema(_FILES).parquet(f"{folder}/table")


_FILES = common.schema(part="int", path="string", n_ids="long", n_docs="long")
_FILES_ARROW = pa.schema([("part", pa.int32()), ("path", pa.string()), ("n_ids", pa.int64()), ("n_docs", pa.int64())])
_DOCS = common.schema(doc_id="long", start="long", n_tokens="long", ids_crc32="long", path="string")
_DOCS_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("path", pa.string())])


def read_digest(files: DataFrame, folder: str) -> DataFrame:
    """Read every file of the table that ``write`` returned: doc_id, start among all ids, n_tokens, ids_crc32, path.

    Starts come from the files' id counts, a table of one row a file. A task reads the files of about ``TASK_IDS`` ids,
    or fewer where that would leave cores idle. An empty table gives no rows.
    """
    from pyspark.sql import Window as W

    n, ids = files.agg(F.count("*"), F.coalesce(F.sum("n_ids"), F.lit(1))).first()
    tasks = max(1, min(n, max(files.sparkSession.sparkContext.defaultParallelism, -(-ids // TASK_IDS))))
    starts = files.withColumn("before", F.sum("n_ids").over(W.orderBy("part")) - F.col("n_ids"))
    dealt = starts.select("part", "path", "before", F.floor(F.col("before") * tasks / ids).alias("task"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as pafs

        store, _ = pafs.FileSystem.from_uri(folder)
        for b in batches:
            for path, before in zip(b.column("path").to_pylist(), b.column("before").to_pylist(), strict=True):
                with store.open_input_file(path) as f:
                    rows = []
                    for d, start, ids in Reader(f).documents():
                        rows.append((d, before + start, len(ids), zlib.crc32(np.ascontiguousarray(ids).tobytes()), path))
                        if len(rows) == 10_000:
                            yield pa.RecordBatch.from_pylist([dict(zip(_DOCS_ARROW.names, r, strict=True)) for r in rows], _DOCS_ARROW)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_pylist([dict(zip(_DOCS_ARROW.names, r, strict=True)) for r in rows], _DOCS_ARROW)

    return dealt.repartitionByRange(tasks, "task").mapInArrow(task, _DOCS)
