"""Approximate nearest neighbours by inner product on shifted space-filling curves.

Vectors get one more component that makes all lengths equal, so that the largest inner product is the least distance.
Each curve turns them at random, keeps ``dims`` of the directions, shifts them, and orders the cells of a grid by
Hilbert's curve. Spark range-partitions every ordering; a query's window on it is ``width`` places to both sides, and
the windows' candidates are merged and reranked by the exact product of the original vectors.

The width is measured: for a sample of queries the true neighbours are found by brute force, and the width is the one
that catches the share ``recall`` of them. Equal vectors are one point of the curves and are told apart afterwards.
Rows are known by a number of their own, so a repeated id harms nothing.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelight.llm import common

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Settings:
    """``sample``: queries, by a hash of their id, on which the width is measured against all vectors. ``least`` and
    ``most``: rows of a block of a curve, the unit of work; a window wider than a block takes several."""

    curves: int = 8
    dims: int = 8
    bits: int = 5
    recall: float = 0.96
    sample: int = 200
    least: int = 256
    most: int = 8192
    seed: int = 13


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on Hilbert's curve of each row of (n, dims) cell numbers below 2**bits; dims * bits is 63 at most.

    Skilling's transposition: undo the rotations from the coarsest bit to the finest, then Gray-decode.
    """
    x = cells.T.astype("i8").copy()
    n = len(x)
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        for i in range(n):
            flip = (x[i] & q) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(flip, q - 1, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        t ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


@dataclass
class Curves:
    """Everything that turns a vector into its keys."""

    settings: Settings
    mean: np.ndarray
    spread: np.ndarray
    longest: float

    def keys(self, x: np.ndarray, query: bool) -> Iterator[np.ndarray]:
        """For each curve the keys of (n, d) vectors. A query is scaled to the greatest length, as its own does not
        change the order of its neighbours."""
        s, d = self.settings, x.shape[1]
        norm = np.sqrt((x * x).sum(axis=1))
        if query:
            x, extra = x * (self.longest / norm)[:, None], np.zeros(len(x))
        else:
            extra = np.sqrt(np.maximum(self.longest**2 - norm**2, 0))
        x = np.concatenate([x, extra[:, None]], axis=1) - self.mean
        for c in range(s.curves):
            rng = np.random.default_rng((s.seed, c))
            dims = min(s.dims, d, 63 // s.bits)
            turn = np.linalg.qr(rng.normal(size=(d + 1, d + 1)))[0][:, :dims]
            spread = np.sqrt(((turn * self.spread[:, None]) ** 2).sum(axis=0)) + 1e-12
            z = np.clip(x @ turn / spread, -6, 6)
            even = 0.5 * (1 + np.tanh(0.7978845608 * (z + 0.044715 * z**3)))  # near to the normal distribution's
            cells = ((even + rng.random(dims)) / 2 * (1 << s.bits)).astype("i8")
            yield hilbert(np.clip(cells, 0, (1 << s.bits) - 1), s.bits)


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of pairs of rows, summed alike for equal rows wherever they stand."""
    return (q * x).sum(axis=-1)


def _matrix(raw: list[bytes], d: int) -> np.ndarray:
    """Doubles of stored vectors, whose components have 4 or 8 bytes."""
    kind = "f4" if raw and len(raw[0]) == 4 * d else "f8"
    return np.frombuffer(b"".join(raw), kind).reshape(len(raw), d).astype("f8")


def _first(score: np.ndarray, ids: np.ndarray, pids: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` best: largest score, then smallest id, then smallest row number."""
    return np.lexsort((pids, ids, -score))[:k]


def _best(q: np.ndarray, x: np.ndarray, ids: np.ndarray, pids: np.ndarray, own: np.ndarray, k: int, far: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each query the row numbers, ids and exact scores of its ``k`` best of ``x``, without its own row and what is
    far. The matrix product only finds what could be among them: all that lies within its error of the k-th."""
    rough = q @ x.T
    rough[own[:, None] == pids[None, :]] = -np.inf
    if far is not None:
        rough[far] = -np.inf
    size = np.sqrt((q * q).sum(axis=1)) * np.sqrt((x * x).sum(axis=1).max(initial=0.0))
    least = np.full(len(q), -np.inf) if len(x) <= k else np.partition(rough, len(x) - k, axis=1)[:, len(x) - k] - 8 * x.shape[1] * np.finfo("f8").eps * size
    out = []
    for i in range(len(q)):
        mine = np.flatnonzero((rough[i] >= least[i]) & np.isfinite(rough[i]))
        score = exact(q[i], x[mine])
        order = _first(score, ids[mine], pids[mine], k)
        out.append((pids[mine][order], ids[mine][order], score[order]))
    return out


def _vectors(table: DataFrame, key: str, column: str, is_query: Column) -> tuple[DataFrame, int]:
    """(pid, id, q, v) of the vectors that take part, stored, and their dimension; pid numbers the rows, v holds the
    components as bytes: 4 each where the column is of floats, else 8."""
    kind = "f4" if "float" in table.schema[column].dataType.simpleString() else "f8"
    x = F.col(column).cast("array<float>" if kind == "f4" else "array<double>")
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf"))) & F.exists(x, lambda e: e != 0)
    rows = table.filter(F.col(key).isNotNull() & F.col(column).isNotNull() & fine).select(F.col(key).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("q"), x.alias("x"))
    sizes = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    d = sizes[0]["d"] if sizes else 1
    arrow = pa.schema([("id", pa.int64()), ("q", pa.bool_()), ("v", pa.binary())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                m = b.column(2).flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(b.num_rows, d) + np.zeros((), kind)  # -0.0 is 0.0
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r.tobytes() for r in m], pa.binary())], schema=arrow)

    held = rows.filter(F.size("x") == d).mapInArrow(task, common.schema(id="long", q="boolean", v="binary"))
    return common.stored(held.select(F.monotonically_increasing_id().alias("pid"), "id", "q", "v"), "vectors"), d


def _curves(points: DataFrame, d: int, s: Settings) -> Curves:
    """Means and spreads over all points; ``d`` rows a task are sent."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, square, most = 0, np.zeros(d), np.zeros(d), 0.0
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(0).to_pylist(), d)
                n += len(x)
                total += x.sum(axis=0)
                square += (x * x).sum(axis=0)
                most = max(most, float((x * x).sum(axis=1).max()))
        if n:
            yield pa.RecordBatch.from_pydict({"pos": np.arange(d), "n": np.full(d, n), "total": total, "square": square, "most": np.full(d, most)})

    kind = common.schema(pos="long", n="long", total="double", square="double", most="double")
    sums = points.select("v").mapInArrow(task, kind).groupBy("pos").agg(F.sum("n").alias("n"), F.sum("total").alias("t"), F.sum("square").alias("s"), F.max("most").alias("m")).orderBy("pos").collect()
    mean = np.array([r["t"] / r["n"] for r in sums] or [0.0] * d)
    spread = np.sqrt(np.maximum([r["s"] / r["n"] for r in sums] or [0.0] * d, mean**2) - mean**2)
    longest = float(np.sqrt(sums[0]["m"])) if sums else 1.0
    extra = np.sqrt(max(longest**2 - sum(r["s"] / r["n"] for r in sums), 0.0))
    return Curves(s, np.append(mean, extra / 2), np.append(spread, extra / 2), longest)


def _ranks(points: DataFrame, curves: Curves, d: int) -> DataFrame:
    """(curve, kind, pid, rank): the place of each point (kind 0) and query (kind 1) in each ordering, stored."""
    key_schema = pa.schema([("curve", pa.int32()), ("key", pa.int64()), ("pid", pa.int64()), ("kind", pa.int32())])
    held = points.sparkSession.sparkContext.broadcast(curves)  # a few numbers a component

    def to_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, q = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False).astype(bool)
            x = _matrix(b.column(2).to_pylist(), d) if b.num_rows else np.zeros((0, d))
            for kind, own in ((0, np.ones(len(x), bool)), (1, q)):
                for c, k in enumerate(held.value.keys(x[own], kind == 1) if own.any() else ()):
                    n = len(k)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, c, "i4")), pa.array(k), pa.array(ids[own]), pa.array(np.full(n, kind, "i4"))], schema=key_schema)

    keyed = points.select("pid", "q", "v").mapInArrow(to_keys, common.schema(curve="int", key="long", pid="long", kind="int"))
    order = ("curve", "key", "pid", "kind")
    sorted_ = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
    arrow = pa.schema([("curve", pa.int32()), ("kind", pa.int32()), ("pid", pa.int64()), ("part", pa.int32()), ("at", pa.int64())])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), {}
        for b in batches:
            c = b.column(0).to_numpy()
            at = np.empty(len(c), "i8")
            for k in np.unique(c).tolist():
                own = np.flatnonzero(c == k)
                at[own] = seen.get(k, 0) + np.arange(len(own))
                seen[k] = seen.get(k, 0) + len(own)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(3), b.column(2), pa.array(np.full(len(c), part, "i4")), pa.array(at)], schema=arrow)

    from pyspark.sql import Window as W

    local = common.stored(sorted_.mapInArrow(number, common.schema(curve="int", kind="int", pid="long", part="int", at="long")), "places")
    sizes = local.groupBy("curve", "part").count()
    # a row a task and curve
    before = sizes.select("curve", "part", (F.sum("count").over(W.partitionBy("curve").orderBy("part")) - F.col("count")).alias("before"))
    return common.stored(local.join(F.broadcast(before), ["curve", "part"]).select("curve", "kind", "pid", (F.col("before") + F.col("at")).alias("rank")), "ranks")


def _true(points: DataFrame, some: list, k: int, d: int) -> DataFrame:
    """(q, pid): the true neighbours of a few queries, by brute force over all points."""
    held = points.sparkSession.sparkContext.broadcast((np.array([r["pid"] for r in some]), _matrix([bytes(r["v"]) for r in some], d)))
    kind = common.schema(q="long", pid="long", id="long", score="double")

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, q = held.value
        none = np.zeros(0, "i8"), np.zeros(0, "i8"), np.zeros(0)
        held_ = [none] * len(own)
        for b in batches:
            for i in range(0, b.num_rows, 4096):
                part = b.slice(i, 4096)
                found = _best(q, _matrix(part.column(2).to_pylist(), d), part.column(1).to_numpy(), part.column(0).to_numpy(), own, k)
                for n, new in enumerate(found):
                    both = [np.concatenate(x) for x in zip(held_[n], new, strict=True)]
                    order = _first(both[2], both[1], both[0], k)
                    held_[n] = tuple(x[order] for x in both)
        pid, ids, score = (np.concatenate(x) for x in zip(*held_, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, [len(x[0]) for x in held_])), pa.array(pid), pa.array(ids), pa.array(score)], names=["q", "pid", "id", "score"])

    from pyspark.sql import Window as W

    found = points.select("pid", "id", "v").mapInArrow(best, kind)
    return found.withColumn("n", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "id", "pid"))).filter(F.col("n") <= k).select("q", "pid")


def _width(points: DataFrame, ranks: DataFrame, k: int, d: int, s: Settings) -> int:
    """Half the window that catches ``recall`` of the sample's true neighbours."""
    some = points.filter("q").orderBy(F.xxhash64("id"), "id", "pid").limit(s.sample).select("pid", "v").collect()
    if not some:
        return s.least
    true = common.stored(_true(points, some, k, d), "truth")  # sample x k rows
    theirs = ranks.filter("kind = 0").join(F.broadcast(true), "pid").select("curve", "q", "pid", F.col("rank").alias("there"))
    asked = ranks.filter("kind = 1").join(F.broadcast(true.select(F.col("q").alias("pid")).distinct()), "pid").select("curve", F.col("pid").alias("q"), "rank")
    far = theirs.join(asked, ["curve", "q"]).groupBy("q", "pid").agg(F.min(F.abs(F.col("rank") - F.col("there"))).alias("far")).select("far").collect()
    width = max(s.least, int(np.quantile([r["far"] for r in far], s.recall, method="higher")) if far else 0)
    if (n := points.count()) > 4 * s.least and 2 * width * s.curves >= n:
        log.warning("windows of %d places on %d curves hold %.0f %% of %d points between them: these vectors have no near neighbours to speak of", 2 * width, s.curves, 200 * width * s.curves / n, n)
    return width


def nearest(table: DataFrame, is_query: Column, key: str = "vec_id", column: str = "embedding", k: int = 20, settings: Settings | None = None) -> DataFrame:
    """For each query row of ``table`` its ``k`` nearest found among all other rows: query_id, rank (from 1), vec_id,
    score; the inner product in double precision, largest first, ties to the smaller id.

    Vectors that are null, zero, of another than the commonest length, or hold null or non-finite components take no
    part, nor do rows without an id. Rows that repeat an id are rows of their own, as queries and as candidates. With ``k``
    or fewer other rows, all are returned. Other columns are ignored; an empty table gives no rows.
    """
    common.ship(table.sparkSession)
    with common.scratch(table.sparkSession):
        return common.stored(_nearest(table, is_query, key, column, k, settings or Settings()), "nearest", keep=True)


def _nearest(table: DataFrame, is_query: Column, key: str, column: str, k: int, s: Settings) -> DataFrame:
    from pyspark.sql import Window as W

    rows, d = _vectors(table, key, column, is_query)
    # of equal vectors the first stands for all; k + 1 of them are enough for any answer
    w = W.partitionBy("v").orderBy("id", "pid")
    firsts = rows.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= k + 1)
    members = common.stored(firsts.withColumn("rep", F.first("pid").over(w)).select("rep", "pid", "id", "n", F.when(F.col("n") == 1, F.col("v")).alias("v")), "members")
    reps = members.filter("n = 1").select("rep", "id", "v")
    asked = common.stored(rows.filter("q").select("v", F.col("pid").alias("query_pid"), F.col("id").alias("query_id")).join(reps.select("rep", "v"), "v").select("query_pid", "query_id", "rep"), "asked")
    points = reps.join(asked.select("rep").distinct().withColumn("q", F.lit(True)), "rep", "left").select(F.col("rep").alias("pid"), "id", F.coalesce("q", F.lit(False)).alias("q"), "v")
    points = common.stored(points, "points")

    ranks = _ranks(points, _curves(points, d, s), d)
    width = _width(points, ranks, k, d, s)
    block = min(s.most, width)
    at = lambda x: F.floor(x / block).cast("long")
    there = ranks.filter("kind = 0").withColumn("block", at(F.col("rank"))).join(points.select("pid", "id", "v"), "pid")
    here = ranks.filter("kind = 1").withColumn("block", F.explode(F.sequence(at(F.greatest(F.col("rank") - width, F.lit(0))), at(F.col("rank") + width)))).join(points.select("pid", "v"), "pid")

    # new columns: both sides come from one table
    there = there.select(*[F.col(c).alias(f"p_{c}") for c in ("curve", "block", "pid", "id", "rank", "v")])
    here = here.select(*[F.col(c).alias(f"q_{c}") for c in ("curve", "block", "pid", "rank", "v")])

    def meet(points_: pd.DataFrame, queries_: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(points_) and len(queries_):
            x, ids, pids, rank = _matrix(list(points_["p_v"]), d), points_["p_id"].to_numpy(), points_["p_pid"].to_numpy(), points_["p_rank"].to_numpy()
            for i in range(0, len(queries_), 512):  # so many queries' products at a time
                own = queries_.iloc[i : i + 512]
                far = np.abs(own["q_rank"].to_numpy()[:, None] - rank[None, :]) > width
                best = _best(_matrix(list(own["q_v"]), d), x, ids, pids, own["q_pid"].to_numpy(), k, far)
                found += [(o, *(y.tobytes() for y in b)) for o, b in zip(own["q_pid"], best, strict=True) if len(b[0])]
        return pd.DataFrame(found, columns=["q", "pids", "ids", "scores"])

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for q, own in pdf.groupby("q"):
            pids, first = np.unique(np.frombuffer(b"".join(own["pids"]), "i8"), return_index=True)
            ids, score = np.frombuffer(b"".join(own["ids"]), "i8")[first], np.frombuffer(b"".join(own["scores"]), "f8")[first]
            order = _first(score, ids, pids, k)
            parts.append(pd.DataFrame({"rep": q, "other": pids[order], "score": score[order]}))
        return pd.concat(parts) if parts else pd.DataFrame({"rep": [], "other": [], "score": []})

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(1).to_pylist(), d)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(0), pa.array(exact(x, x))], names=["rep", "other", "score"])

    kind = common.schema(rep="long", other="long", score="double")
    met = there.groupBy("p_curve", "p_block").cogroup(here.groupBy("q_curve", "q_block")).applyInPandas(meet, common.schema(q="long", pids="binary", ids="binary", scores="binary"))
    slots = max(1, asked.select("rep").distinct().count() // 500)
    near = met.withColumn("slot", F.pmod(F.xxhash64("q"), F.lit(slots))).groupBy("slot").applyInPandas(merge, kind)
    itself = points.filter("q").select("pid", "v").mapInArrow(alone, kind)  # for a query's own copies
    best = W.partitionBy("rep").orderBy(F.desc("score"), "id", "pid")
    close = near.unionByName(itself).join(members.select(F.col("rep").alias("other"), "pid", "id"), "other")
    close = common.stored(close.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k + 1).select("rep", "pid", "id", "score"), "close")
    out = asked.join(close, "rep").filter("pid <> query_pid")
    rank = F.row_number().over(W.partitionBy("query_pid").orderBy(F.desc("score"), "id", "pid"))
    return out.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias("vec_id"), "score")
