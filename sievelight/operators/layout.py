"""Shapes of a matrix: dense rows, triples (row_id, col_id, val), compressed rows and columns, packets, row partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievelight.functions import MatrixMeta

#: Keys of one bucket of a running sum.
RUN_KEYS = 65_536


def to_triples(dense: DataFrame, row: str = "row_id", vector: str = "embedding", keep_zeros: bool = True) -> DataFrame:
    """Triples of dense rows; zeros only on demand. Null vectors and components have no triples."""
    out = dense.select(F.col(row).alias("row_id"), F.posexplode(vector).alias("col_id", "v"))
    out = out.select("row_id", "col_id", F.col("v").cast("double").alias("val")).filter("val is not null")
    return out if keep_zeros else out.filter("val <> 0")


def to_dense(triples: DataFrame, cols: int) -> DataFrame:
    """Dense rows of triples without repeated cells; a row without triples does not appear."""
    cells = F.map_from_entries(F.collect_list(F.struct("col_id", "val")))
    return triples.groupBy("row_id").agg(cells.alias("m")).select("row_id", F.transform(F.sequence(F.lit(0), F.lit(cols - 1)), lambda c: F.coalesce(F.col("m")[c], F.lit(0.0))).alias("embedding"))


def ordered(triples: DataFrame) -> DataFrame:
    """Triples by row and column: ranges of rows, sorted inside, which is what a sorted table needs."""
    return triples.repartitionByRange("row_id", "col_id").sortWithinPartitions("row_id", "col_id")


def deduplicated(triples: DataFrame, how: str = "sum", order: str | None = None) -> DataFrame:
    """One triple a cell: the ``sum``, the ``last`` by ``order``, or an ``error`` on the first action if cells repeat."""
    cell = triples.groupBy("row_id", "col_id")
    if how == "sum":
        return cell.agg(F.sum("val").alias("val"))
    if how == "last":
        return cell.agg(F.max_by("val", order).alias("val"))
    if how == "error":
        once = F.when(F.count("*") > 1, F.raise_error(F.lit("a cell occurs twice"))).otherwise(F.first("val"))
        return cell.agg(once.cast("double").alias("val"))
    raise ValueError(f"unknown way {how!r}")


def meta(triples: DataFrame, rows: int | None = None, cols: int | None = None) -> MatrixMeta:
    """Shape and entries; without given ``rows`` and ``cols``, one more than the largest index."""
    r = triples.agg(F.count("*").alias("n"), F.max("row_id").alias("r"), F.max("col_id").alias("c")).first()
    return MatrixMeta(rows if rows is not None else (r["r"] if r["r"] is not None else -1) + 1, cols if cols is not None else (r["c"] if r["c"] is not None else -1) + 1, r["n"])


def compressed(triples: DataFrame, by: str = "row_id") -> DataFrame:
    """Compressed rows (or columns): the key, sorted indices and their values as arrays."""
    other = "col_id" if by == "row_id" else "row_id"
    return triples.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(other, "val"))).alias("e")).select(by, F.col(f"e.{other}").alias("indices"), F.col("e.val").alias("values"))


def lengths(triples: DataFrame, by: str = "row_id") -> DataFrame:
    """Entries of each row or column that has any."""
    return triples.groupBy(by).agg(F.count("*").alias("nnz"))


def running(rows: DataFrame, value: str, part: str, key: str, order: tuple[str, ...], out: str, keys: int = RUN_KEYS) -> DataFrame:
    """Add ``out``: the sum of ``value`` over a part's rows before and with this one, by ``order``, whose first column
    is the integer ``key``.

    Buckets of ``keys`` keys are summed first, then each is run through on its own: no task sees a whole part, and the
    table of buckets is smaller than the rows by that factor.
    """
    rows = rows.withColumn("bucket_", F.floor(F.col(key) / keys))
    sums = rows.groupBy(part, "bucket_").agg(F.sum(value).alias("n"))
    sums = sums.select(F.col(part).alias("part_"), F.col("bucket_").alias("of_"), (F.sum("n").over(W.partitionBy(part).orderBy("bucket_")) - F.col("n")).alias("before_"))
    own = F.sum(value).over(W.partitionBy(part, "bucket_").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    placed = rows.withColumn("own_", own).join(sums, (F.col(part) == F.col("part_")) & (F.col("bucket_") == F.col("of_")))
    return placed.withColumn(out, F.col("own_") + F.col("before_")).drop("bucket_", "part_", "of_", "before_", "own_")


def pointers(triples: DataFrame, by: str = "row_id") -> DataFrame:
    """Where each row's entries begin and end in row order, as (key, begin, end)."""
    counts = lengths(triples, by).withColumn("all_", F.lit(0))
    return running(counts, "nnz", "all_", by, (by,), "end").select(by, (F.col("end") - F.col("nnz")).alias("begin"), "end")


def affine_shuffle(triples: DataFrame, rows: int, a: int, b: int) -> DataFrame:
    """Renumber rows by (row * a + b) mod rows; ``a`` and ``rows`` must have no common factor."""
    from math import gcd

    if gcd(a, rows) != 1:
        raise ValueError(f"{a} and {rows} have a common factor: rows would collide")
    return triples.withColumn("row_id", (F.col("row_id") * a + b) % rows)


def hash_shuffle(triples: DataFrame, seed: int) -> DataFrame:
    """Add ``order_key``, a hash of the row by which rows can be dealt at random; equal for all entries of a row."""
    return triples.withColumn("order_key", F.xxhash64("row_id", F.lit(seed)))


def split_of(row: Column, rows: int, parts: int, how: str = "floor") -> Column:
    """The part of a row. floor: equal slices, the last takes the rest; ceil: slices of the next larger size, so the last
    may be short; balanced: the first ``rows % parts`` parts have one more."""
    if rows < parts:
        raise ValueError(f"{rows} rows cannot be split into {parts} parts")
    if how == "floor":
        return F.least(F.floor(row / (rows // parts)), F.lit(parts - 1)).cast("int")
    if how == "ceil":
        return F.floor(row / -(-rows // parts)).cast("int")
    if how == "balanced":
        small, more = divmod(rows, parts)
        edge = more * (small + 1)
        return F.when(row < edge, F.floor(row / (small + 1))).otherwise(more + F.floor((row - edge) / small)).cast("int")
    raise ValueError(f"unknown split {how!r}")


def split_summary(triples: DataFrame, part: Column, packet: int = 30) -> DataFrame:
    """First and last row, entries and packets of each part."""
    return triples.groupBy(part.alias("part")).agg(F.min("row_id").alias("first_row"), F.max("row_id").alias("last_row"), F.count("*").alias("nnz"), F.ceil(F.count("*") / packet).cast("bigint").alias("packets"))


def mirrored(edges: DataFrame) -> DataFrame:
    """Edges (src, dst) in both directions, each once."""
    return edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def without_loops(edges: DataFrame) -> DataFrame:
    """Edges between different nodes, each once."""
    return edges.select("src", "dst").filter("src <> dst").distinct()


def gather(triples: DataFrame, ids: DataFrame, row: str = "row_id") -> DataFrame:
    """The entries of the listed rows."""
    return triples.join(ids.select(row).distinct(), row, "left_semi")


def with_diagonal(triples: DataFrame, rows: int) -> DataFrame:
    """Rows without entries get a zero on the diagonal, so that every row occurs."""
    all_ = triples.sparkSession.range(rows).withColumnRenamed("id", "row_id")
    missing = all_.join(triples.select("row_id").distinct(), "row_id", "left_anti")
    return triples.select("row_id", "col_id", "val").unionByName(missing.select("row_id", F.col("row_id").cast("int").alias("col_id"), F.lit(0.0).alias("val")))


def histogram(triples: DataFrame, width: float, origin: float = 0.0, part: Column | None = None) -> DataFrame:
    """Entries by value bin, and by part if one is given; bin 0 starts at ``origin``."""
    keys = [F.floor((F.col("val") - origin) / width).cast("int").alias("bin")]
    return triples.groupBy(*([part.alias("part")] if part is not None else []), *keys).agg(F.count("*").alias("n"))


#: Entries in a packet of either format.
ROW_BIT_LANES, ROW_END_LANES = 30, 11


# -- packets -------------------------------------------------------------------------------------------------------


def placed(q: DataFrame, part: Column, lanes: int) -> DataFrame:
    """Each entry's place in its part: pos, pkt, lane, whether it starts a row (first), and whether it starts one that is
    not the part's first (new)."""
    rows = q.withColumn("part", part).withColumn("one", F.lit(1))
    rows = running(rows, "one", "part", "row_id", ("row_id", "col_id"), "pos").withColumn("pos", F.col("pos") - 1)
    first = F.row_number().over(W.partitionBy("part", "row_id").orderBy("col_id")) == 1
    rows = rows.withColumn("first", first.cast("int")).withColumn("new", (first & (F.col("pos") > 0)).cast("int"))
    return rows.drop("one").withColumn("pkt", F.expr(f"pos div {lanes}")).withColumn("lane", (F.col("pos") % lanes).cast("int"))


def row_bit_packets(q: DataFrame, part: Column, lanes: int = ROW_BIT_LANES) -> DataFrame:
    """Packets of ``lanes`` entries (row_id, col_id, q) with one bit an entry: set where the row differs from the entry
    before, across packets of a part too. The last packet is filled with zeros."""
    rows = placed(q, part, lanes)
    got = rows.groupBy("part", "pkt").agg(
        F.sum(F.expr("shiftleft(cast(new as bigint), lane)")).alias("row_bits"),
        F.array_sort(F.collect_list(F.struct("lane", "col_id", "q"))).alias("e"),
        F.min("row_id").alias("first_row"),
    )
    fill = lambda c: F.concat(c, F.array_repeat(F.lit(0), lanes - F.size("e")))
    return got.select("part", "pkt", "first_row", "row_bits", F.size("e").alias("used"), fill(F.col("e.col_id")).alias("cols"), fill(F.col("e.q")).alias("vals"))


def decode_row_bits(packets: DataFrame) -> DataFrame:
    """Entries of the packets: part, the row's number in the order of the part's rows, col_id, q."""
    rows = running(packets.withColumn("bits_", F.bit_count("row_bits")), "bits_", "part", "pkt", ("pkt",), "upto_").withColumn("before", F.col("upto_") - F.col("bits_"))
    rows = rows.select("part", "before", "row_bits", F.posexplode(F.slice(F.arrays_zip("cols", "vals"), 1, F.col("used"))).alias("lane", "e"))
    upto = F.expr("bit_count(row_bits & (shiftleft(1L, lane + 1) - 1))")
    return rows.select("part", (F.col("before") + upto).cast("bigint").alias("row_no"), F.col("e.cols").alias("col_id"), F.col("e.vals").alias("q"))


def row_end_packets(q: DataFrame, part: Column, lanes: int = ROW_END_LANES) -> DataFrame:
    """Packets of ``lanes`` entries (row_id, col_id, q) with the running number of entries at each row's end and a flag
    whether the packet's first entry starts a row. The last packet of a part may be short."""
    rows = placed(q, part, lanes)
    ends = rows.groupBy("part", "pkt", "row_id").agg(F.count("*").alias("n"), F.min(F.when(F.col("lane") == 0, F.col("first"))).alias("starts"), F.collect_list(F.struct("lane", "col_id", "q")).alias("e"))
    w = W.partitionBy("part", "pkt").orderBy("row_id")  # at most ``lanes`` rows
    ends = ends.withColumn("row_end", F.sum("n").over(w))
    got = ends.groupBy("part", "pkt").agg(F.max("starts").cast("int").alias("new_row"), F.array_sort(F.collect_list("row_end")).alias("row_ends"), F.sum("n").alias("used"), F.array_sort(F.flatten(F.collect_list("e"))).alias("e"))
    return got.select("part", "pkt", "new_row", "row_ends", "used", F.col("e.col_id").alias("cols"), F.col("e.q").alias("vals"))


def decode_row_ends(packets: DataFrame) -> DataFrame:
    """Entries of the packets: part, the row's number in the order of the part's rows, col_id, q."""
    rows = running(packets.withColumn("starts_", F.size("row_ends") - 1 + F.col("new_row")), "starts_", "part", "pkt", ("pkt",), "upto_")
    rows = rows.withColumn("before", F.col("upto_") - F.col("starts_") - 1 + F.col("new_row"))
    rows = rows.select("part", "before", "row_ends", F.posexplode(F.arrays_zip("cols", "vals")).alias("lane", "e"))
    passed = F.size(F.filter("row_ends", lambda x: x <= F.col("lane")))
    return rows.select("part", (F.col("before") + passed).cast("bigint").alias("row_no"), F.col("e.cols").alias("col_id"), F.col("e.vals").alias("q"))
