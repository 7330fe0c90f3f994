"""MatrixMarket text files as triples (row_id, col_id, val) with 0-based ids, and back."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelight.functions import MatrixMeta
from sievelight.operators import layout

FIELDS = ("real", "integer", "pattern", "complex")
SYMMETRIES = ("general", "symmetric", "skew-symmetric", "hermitian")


class MatrixMarketError(ValueError):
    """A file that is not a MatrixMarket matrix that can be read; ``reason`` is a short word for the cause."""

    def __init__(self, reason: str, text: str):
        super().__init__(f"{reason}: {text}")
        self.reason = reason


@dataclass(frozen=True)
class Header:
    layout: str
    field: str
    symmetry: str
    rows: int
    cols: int
    nnz: int


def parse_header(lines: list[str]) -> Header:
    """The banner and the size line among a file's first lines."""
    if not lines:
        raise MatrixMarketError("empty", "no lines")
    words = lines[0].split()
    if len(words) != 5 or words[0] != "%%MatrixMarket":
        raise MatrixMarketError("banner", lines[0][:80])
    kind, form, field, symmetry = (w.lower() for w in words[1:])
    if kind != "matrix" or form not in ("coordinate", "array") or field not in FIELDS or symmetry not in SYMMETRIES:
        raise MatrixMarketError("type", lines[0][:80])
    if form == "array" and field == "pattern" or symmetry == "hermitian" and field != "complex" or field == "pattern" and symmetry == "skew-symmetric":
        raise MatrixMarketError("type", "these do not go together")
    if form == "array" or field == "complex":
        raise MatrixMarketError("unsupported", f"{form} {field}")
    sizes = next((x.split() for x in lines[1:] if x.strip() and not x.startswith("%")), None)
    if sizes is None:
        raise MatrixMarketError("size", "no size line")
    try:
        rows, cols, nnz = map(int, sizes)
    except ValueError:
        raise MatrixMarketError("size", " ".join(sizes)[:80]) from None
    if min(rows, cols, nnz) < 0:
        raise MatrixMarketError("size", " ".join(sizes))
    return Header(form, field, symmetry, rows, cols, nnz)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select("value", F.input_file_block_start().alias("block"), F.monotonically_increasing_id().alias("n"))


def read_header(spark: SparkSession, path: str) -> Header:
    lines = _lines(spark, path).filter("block = 0")
    size_line = lines.filter("trim(value) <> '' and not startswith(value, '%')").agg(F.min("n")).first()[0]
    banner = lines.orderBy("n").select("value").first()
    size = lines.filter(F.col("n") == size_line).first() if size_line is not None else None
    return parse_header([x["value"] for x in (banner, size) if x is not None])


def read(spark: SparkSession, path: str, direction: str = "banner", values: bool = True, one_based: bool = True, drop_loops: bool = False, dedupe: str | None = "sum", check: bool = True) -> tuple[DataFrame, MatrixMeta]:
    """Triples and shape of one file.

    direction: ``as_is``; ``banner`` mirrors where the banner says symmetric (with the sign turned if skew); ``both``
    always mirrors. ``values=False`` reads 1.0 for every entry, as pattern files do. ``check`` fails on ids outside of
    the shape. The size line is never an entry.
    """
    head = read_header(spark, path)
    lines = _lines(spark, path).filter("trim(value) <> '' and not startswith(value, '%')")
    size_line = lines.filter("block = 0").agg(F.min("n")).first()[0]
    w = F.split(F.trim("value"), r"\s+")
    base = 1 if one_based else 0
    pattern = head.field == "pattern" or not values
    rows = lines.filter(F.col("n") != size_line).select((w[0].cast("bigint") - base).alias("row_id"), (w[1].cast("int") - base).alias("col_id"), (F.lit(1.0) if pattern else w[2].cast("double")).alias("val"))
    if check:
        inside = F.col("row_id").between(0, head.rows - 1) & F.col("col_id").between(0, head.cols - 1)
        fault = F.raise_error(F.concat(F.lit("an entry lies outside of the matrix: "), F.col("row_id").cast("string"), F.lit(" "), F.col("col_id").cast("string")))
        rows = rows.withColumn("val", F.when(inside, F.col("val")).otherwise(fault.cast("double")))
    if drop_loops:
        rows = rows.filter("row_id <> col_id")
    if direction == "both" or direction == "banner" and head.symmetry != "general":
        sign = -1.0 if head.symmetry == "skew-symmetric" else 1.0
        turned = rows.filter("row_id <> col_id").select(F.col("col_id").cast("bigint").alias("row_id"), F.col("row_id").cast("int").alias("col_id"), (F.col("val") * sign).alias("val"))
        rows = rows.unionByName(turned)
    elif direction not in ("as_is", "banner"):
        raise ValueError(f"unknown direction {direction!r}")
    if dedupe:
        rows = layout.deduplicated(rows, dedupe)
    return rows, MatrixMeta(head.rows, head.cols, head.nnz)


def read_graph(spark: SparkSession, path: str, directed: bool = True) -> DataFrame:
    """A pattern file as weighted edges (src, dst, weight): without loops, each edge once, weight 1 over the edges that
    leave src."""
    from sievelight.operators import graph

    cells, _ = read(spark, path, "as_is" if directed else "both", values=False, drop_loops=True)
    return graph.out_degree_weights(cells.select(F.col("row_id").alias("src"), F.col("col_id").cast("bigint").alias("dst")))


def write(triples: DataFrame, path: str, shape: MatrixMeta, field: str = "real", column: str = "val") -> None:
    """One 1-based text file below ``path``, zeros left out; for exchange. Keep large matrices as Parquet."""
    entries = triples.filter(F.col(column) != 0)
    body = entries.select("row_id", "col_id", F.concat_ws(" ", F.col("row_id") + 1, F.col("col_id") + 1, F.col(column)).alias("value"))
    n = entries.count()
    head = triples.sparkSession.createDataFrame([(-2, 0, f"%%MatrixMarket matrix coordinate {field} general"), (-1, 0, f"{shape.rows} {shape.cols} {n}")], body.schema)
    head.unionByName(body).coalesce(1).sortWithinPartitions("row_id", "col_id").select("value").write.text(path)
