"""K-d tree sharding: documents are split at weighted medians of metadata until every leaf holds its share of bytes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelight.llm import common

#: A coordinate has this many bits; below it stand 32 bits of a hash of the row, so that ties can be split.
COORD_BITS, TIE_BITS = 24, 32
#: Bins of one search pass; a pass returns a sum for each bin and node.
BINS = 1024
#: Rows that one numbering bucket of a shard should have.
SLOT_ROWS = 4000


@dataclass
class Node:
    """A box of the tree: ``leaves`` shards from ``first`` on. A split sends keys of ``dim`` below ``at`` to the left."""

    first: int
    leaves: int
    dim: int = -1
    at: int = 0
    left: Node | None = None
    right: Node | None = None

    def shard(self, keys: list[Column]) -> Column:
        if self.left is None:
            return F.lit(self.first)
        return F.when(keys[self.dim] < self.at, self.left.shard(keys)).otherwise(self.right.shard(keys))


def _tree(rows: DataFrame, n_dims: int, shards: int) -> Node:
    """The tree for ``rows`` (k0 ... kn, size). All nodes of a level are searched together; what reaches the driver is
    a range for each node and dimension and a sum for each node and bin."""
    root = Node(0, shards)
    level, keys = [root], [F.col(f"k{i}") for i in range(n_dims)]
    while open_ := [x for x in level if x.leaves > 1]:
        here = rows.withColumn("node", root.shard(keys))
        ends = [f(F.shiftright(k, TIE_BITS)).alias(f"{name}{i}") for i, k in enumerate(keys) for name, f in (("lo", F.min), ("hi", F.max))]
        stats = {r["node"]: r for r in here.groupBy("node").agg(F.sum("size").alias("bytes"), *ends).collect()}
        search = {}
        for x in open_:
            if (r := stats.get(x.first)) is None:
                x.dim, x.at = 0, 0  # an empty box: all its leaves stay empty but the last
                continue
            x.dim = max(range(n_dims), key=lambda i: (r[f"hi{i}"] - r[f"lo{i}"], -i))
            lo, hi = r[f"lo{x.dim}"] << TIE_BITS, (r[f"hi{x.dim}"] + 1) << TIE_BITS
            search[x.first] = [x, lo, hi, r["bytes"] * (x.leaves // 2) / x.leaves, 0]
        while narrow := {k: s for k, s in search.items() if s[2] - s[1] > 1}:
            pick = lambda f: F.coalesce(*[F.when(F.col("node") == k, f(s)) for k, s in narrow.items()])  # noqa: E731, B023
            steps = {k: -(-(s[2] - s[1]) // BINS) for k, s in narrow.items()}
            binned = here.select("size", pick(lambda s: keys[s[0].dim] - s[1]).alias("d"), pick(lambda s: F.lit(s[2] - s[1])).alias("range"), pick(lambda s: F.lit(steps[s[0].first])).alias("step"), "node")
            sums: dict[int, dict[int, int]] = {}
            for r in binned.filter("d >= 0 and d < range").groupBy("node", F.expr("d div step").alias("bin")).agg(F.sum("size").alias("bytes")).collect():
                sums.setdefault(r["node"], {})[r["bin"]] = r["bytes"]
            for k, s in narrow.items():
                below, step = s[4], steps[k]
                for b, w in sorted(sums[k].items()):
                    if below + w >= s[3]:
                        lo = s[1] + b * step
                        s[1], s[2], s[4] = lo, min(lo + step, s[2]), below
                        if s[2] - s[1] == 1:  # one key: it goes where the halves come nearer to their shares
                            s[1] += abs(below + w - s[3]) < abs(below - s[3])
                            s[2] = s[1]
                        break
                    below += w
                else:
                    s[1] = s[2]
        for x, at, *_ in search.values():
            x.at = at
        level = []
        for x in open_:
            half = x.leaves // 2
            x.left, x.right = Node(x.first, half), Node(x.first + half, x.leaves - half)
            level += [x.left, x.right]
    return root


def shard(docs: DataFrame, shards: int = 8, dimensions: tuple[str, ...] = ("doc_id", "size", "lang", "source"), target_bytes: int | None = None) -> DataFrame:
    """Deal all ``docs`` (doc_id, text and the dimensions) into ``shards`` leaves of near equal bytes, or into as many as
    bring each down to ``target_bytes`` if that is given.

    A number is a coordinate by its place between the least and the largest value (``size`` by its logarithm), any
    other value by its hash. Each box is split along the dimension in which it is widest, where the left half has its
    share of bytes; rows with equal coordinates are split by a hash of id and text. Size: UTF-8 bytes plus 1, so a null
    text has size 1 and checksum 0. Nulls in a dimension count as its least value. Repeated rows stay apart; a
    dimension that the table lacks is left out; other columns are ignored. An empty table gives no rows.

    Returns doc_id, size, text_crc32, law (``bytes``), shard, slot (gapless from 0 in each shard), grown_shard (null).
    """
    raw = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    own = [c for c in dimensions if c in docs.columns and c != "size"]
    meta = docs.select("doc_id", *[F.col(c).alias(f"dim_{c}") for c in own], (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    kinds = dict(docs.dtypes)
    value = {}
    for c in dimensions:
        if c == "size":
            value[c] = F.log("size")
        elif c in own:
            number = kinds[c] in ("tinyint", "smallint", "int", "bigint", "float", "double") or kinds[c].startswith("decimal")
            value[c] = F.col(f"dim_{c}").cast("double") if number else F.when(F.col(f"dim_{c}").isNotNull(), F.pmod(F.xxhash64(f"dim_{c}"), F.lit(1 << COORD_BITS)).cast("double"))
    valued = common.stored(meta.select("doc_id", "size", "text_crc32", *[v.alias(f"v{i}") for i, v in enumerate(value.values())]), "shard-meta")
    ends = valued.agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), *[f(f"v{i}").alias(f"{name}{i}") for i in range(len(value)) for name, f in (("lo", F.min), ("hi", F.max))]).first()
    if target_bytes:
        shards = max(1, -(-(ends["bytes"] or 0) // target_bytes))
    tie = F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(1 << TIE_BITS))
    keys = []
    for i in range(len(value)):
        lo, hi = ends[f"lo{i}"], ends[f"hi{i}"]
        place = F.lit(0.0) if lo is None or hi <= lo else F.coalesce((F.col(f"v{i}") - lo) / (hi - lo), F.lit(0.0))
        coord = F.least(F.floor(place * (1 << COORD_BITS)), F.lit((1 << COORD_BITS) - 1)).cast("long")
        keys.append((F.shiftleft(coord, TIE_BITS) + tie).alias(f"k{i}"))
    rows = valued.select("doc_id", "size", "text_crc32", *keys)
    root = _tree(rows, len(value), shards) if ends["n"] else Node(0, 1)
    placed = rows.select("doc_id", "size", "text_crc32", root.shard([F.col(f"k{i}") for i in range(len(value))]).cast("int").alias("shard"))
    buckets = max(1, -(-ends["n"] // (SLOT_ROWS * shards)))
    out = common.numbered(placed, "shard", ["doc_id", "text_crc32", "size"], "slot", buckets)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
