"""What the operators of this subpackage share: shipping code, temporary tables, numbering rows, label splits."""

from __future__ import annotations

import ctypes
import hashlib
import io
import os
import sys
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII white space as the contracts define it; ``bytes.split()`` splits at exactly these.
WORD = r"[^\x20\x09-\x0D]+"

_shipped: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Make this package importable in the executors' Python workers, once per application; and lower the rows of an Arrow
    batch for the session, if they are Spark's default, as rows here hold whole texts."""
    sc = spark.sparkContext
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.writestr(zipfile.ZipInfo(str(p.relative_to(root.parent))), p.read_bytes())
    name = f"{root.name}_{hashlib.sha256(held.getvalue()).hexdigest()[:12]}.zip"
    path = os.path.join(tempfile.mkdtemp(), name)
    Path(path).write_bytes(held.getvalue())
    sc.addPyFile(path)  # Spark's own file server hands it to every executor, also to later ones
    _shipped[sc.applicationId] = name


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a folder of our own only in local mode, where
    driver and executors are one process."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not at:
        at = spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="sievelight-")
        spark.sparkContext.setCheckpointDir(at)
    return at if "://" in at or at.startswith("file:") else f"file://{os.path.abspath(at)}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/sievelight/{name}-{uuid.uuid4().hex}"


class _Open(threading.local):
    """Of each thread: what its open ``scratch`` blocks have to delete."""

    def __init__(self):
        self.paths: list[list[str]] = []


_open = _Open()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete the tables that ``stored`` writes inside, but those with ``keep``, when all is done. What leaves the block
    must be such a table."""
    _open.paths.append([])
    try:
        yield
    finally:
        for path in _open.paths.pop():
            drop_path(spark, path)


def stored(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: cuts the lineage and outlives lost executors."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.parquet(path)
    if _open.paths and not keep:
        _open.paths[-1].append(path)
    elif keep and len(_open.paths) > 1:
        _open.paths[-2].append(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a column of ids that may be broadcast (about 40 bytes each in an executor).
BROADCAST_IDS = 2_000_000


def few(ids: DataFrame, most: int | None = None) -> DataFrame:
    """A table of distinct ids, marked for a broadcast if it is counted to be small; it must be cheap to read."""
    return F.broadcast(ids) if ids.count() <= (BROADCAST_IDS if most is None else most) else ids


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a temporary table whose rows are no longer needed."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def split_of(doc_id: Column | str, mod: int) -> Column:
    """crc32 of the id as decimal text, modulo ``mod``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % mod


def numbered(df: DataFrame, group: str, key: list[str], out: str, buckets: int) -> DataFrame:
    """Add ``out``: a gapless number from 0 within each ``group``, without any group in one task.

    Rows are dealt by (group, hash bucket); each is numbered inside its bucket, and the buckets' sizes, a table of
    ``groups x buckets`` rows, give the offsets. The input must give the same rows on every run.
    """
    from pyspark.sql import Window as W

    b = "__bucket"
    rows = df.withColumn(b, F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int"))
    sizes = rows.groupBy(group, b).count()
    offsets = sizes.select(
        F.col(group).alias("__g"),
        F.col(b).alias("__b"),
        (F.sum("count").over(W.partitionBy(group).orderBy(b)) - F.col("count")).alias("__before"),
    )
    local = F.row_number().over(W.partitionBy(group, b).orderBy(*key)) - 1
    return (
        rows.withColumn("__n", local)
        .join(offsets, F.col(group).eqNullSafe(F.col("__g")) & (F.col(b) == F.col("__b")))
        .withColumn(out, (F.col("__before") + F.col("__n")).cast("long"))
        .drop("__n", "__g", "__b", "__before", b)
    )


def begin() -> None:
    """At the start of a task that encodes nothing: drop the encoder that an earlier task left in this worker."""
    if (held := sys.modules.get("sievelight.llm.tokenization")) is not None and held.encoder.cache_info().currsize:
        held.encoder.cache_clear()
        trim()


def trim() -> None:
    """Give memory that a task no longer needs back to the system: workers live on, and so would their peaks."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def _fresh(name: str, taken: list[str]) -> str:
    """A column name that no other has, whatever its case."""
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


def with_score(docs: DataFrame, score: Callable[[list[bytes | None]], np.ndarray], keep: list[str], out: str = "score") -> DataFrame:
    """The columns ``keep`` of each row and ``out``: what ``score`` gives for its whole text, as UTF-8 bytes."""
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").cast("string").alias(_fresh("text_", keep)))
    kind = T.StructType([*[T.StructField(f.name, f.dataType) for f in rows.schema[:-1]], T.StructField(out, T.DoubleType())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin()
        for b in batches:
            if b.num_rows:
                p = score(b.column(len(keep)).cast(pa.binary()).to_pylist())
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(p, pa.float64())], names=[*keep, out])
        trim()

    return rows.mapInArrow(task, kind)


def accepted(docs: DataFrame, accept: Callable[[list[bytes | None]], np.ndarray]) -> DataFrame:
    """The rows, with all their columns, whose text ``accept`` says yes to."""
    rows = docs.select(*[F.col(f"`{c}`") for c in docs.columns], F.col("text").cast("string").alias(_fresh("text_", docs.columns)))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin()
        for b in batches:
            if b.num_rows:
                yes = accept(b.column(b.num_columns - 1).cast(pa.binary()).to_pylist())
                yield pa.RecordBatch.from_arrays(b.columns[:-1], names=b.schema.names[:-1]).filter(pa.array(yes, pa.bool_()))
        trim()

    return rows.mapInArrow(task, T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema]))


_TYPES = {"int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(), "string": T.StringType(), "binary": T.BinaryType(), "boolean": T.BooleanType()}


def schema(**fields: str) -> T.StructType:
    """A Spark schema by type names, without a session."""
    one = lambda v: T.ArrayType(_TYPES[v[6:-1]]) if v.startswith("array<") else _TYPES[v]
    return T.StructType([T.StructField(k, one(v)) for k, v in fields.items()])
