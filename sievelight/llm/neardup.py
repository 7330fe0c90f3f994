"""Near-duplicate detection with HyperMinHash sketches.

A document's shingle set becomes ``BUCKETS`` registers. The top bits of a shingle's hash pick the bucket; of the
bucket's least hash the register keeps the number of leading zeros and ``MANTISSA`` bits after them. Empty buckets
borrow from a bucket that a fixed random order picks, alike in every document. Bands of registers give candidates, a
Jaccard estimate corrected for chance collisions of registers thins them, and the full sets decide.

Documents with equal sets form one class first, so groups of copies never meet in a band. Within a band's bucket no
list of all pairs is made: two rounds test the members against one leader and merge what is linked; only members of
still different components are then compared, block against block.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelight.llm import common

BUCKETS, MANTISSA = 256, 10
#: A pair of similarity 0.8 shares none of 42 bands of 6 registers with probability 3e-6.
BANDS, ROWS = 42, 6
#: Standard errors that the estimate may lie below the threshold.
MARGIN = 4.5
#: Sets under this size skip the estimate: too few registers are independent.
SMALL = 64
#: A bucket of up to this many members lists its open pairs; a larger one is compared in blocks.
LISTED, BLOCK = 8, 512
#: Bands that the first round looks at.
FIRST_BANDS = 6

_MULT = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles of ``width`` words; A-Z are lower-cased, words end at ASCII
    white space. Fewer words make one shingle, no words none."""
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, "u8")
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), "u8", len(words))
    n = max(1, len(h) - width + 1)
    s = np.full(n, min(width, len(h)), "u8")
    for k in range(min(width, len(h))):
        s = (s + h[k : k + n]) * _MULT
    s = _mix(s)
    s.sort()
    return s[np.concatenate(([True], s[1:] != s[:-1]))]


@lru_cache
def _orders() -> np.ndarray:
    """For each bucket: all buckets in the order in which it borrows."""
    return np.argsort(_mix(np.arange(BUCKETS * BUCKETS, dtype="u8") + np.uint64(1)).reshape(BUCKETS, BUCKETS), axis=1)


def sketch(s: np.ndarray) -> np.ndarray:
    """Registers of a non-empty sorted set of hashes, 16 bits each."""
    bits = np.uint64(BUCKETS.bit_length() - 1)
    at = np.searchsorted(s, np.arange(BUCKETS, dtype="u8") << (np.uint64(64) - bits))
    full = np.diff(at, append=len(s)) > 0
    v = s[at[full]] << bits
    zeros = 53 - np.frexp((v >> np.uint64(11)).astype("f8"))[1].astype("i8")
    after = (v << np.minimum(zeros + 1, 63).astype("u8")) >> np.uint64(64 - MANTISSA)
    out = np.zeros(BUCKETS, "<u2")
    out[full] = (zeros.astype("u8") << np.uint64(MANTISSA)) | after
    if not full.all():
        order = _orders()[~full]
        out[~full] = out[order[np.arange(len(order)), full[order].argmax(axis=1)]]
    return out


def band_keys(registers: np.ndarray) -> np.ndarray:
    """(documents, BANDS) keys of (documents, BUCKETS) registers."""
    r = registers[:, : BANDS * ROWS].reshape(len(registers), BANDS, ROWS).astype("u8")
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype="u8"), r.shape[:2]).copy()
    for k in range(ROWS):
        key = _mix(key * _MULT + r[:, :, k])
    return key.view("i8")


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Jaccard similarity of pairs of sketches, from the share of equal registers less the share equal by chance."""
    same = (a == b).mean(axis=-1)
    level = np.arange(54)

    def share(n: np.ndarray) -> np.ndarray:  # of leading zeros, for the least of n / BUCKETS values
        k = np.maximum(n / BUCKETS, 1.0)[..., None]
        return (1 - 0.5 ** (level + 1.0)) ** k - (1 - 0.5**level) ** k

    chance = (share(na) * share(nb)).sum(axis=-1) / 2**MANTISSA
    return np.clip((same - chance) / (1 - chance), 0, 1)


def _likely(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    t = percent / 100
    least = t - MARGIN * (t * (1 - t) / BUCKETS) ** 0.5
    return (np.minimum(na, nb) < SMALL) | (estimate(a, b, na, nb) >= least)


def _sizes_fit(na: Column, nb: Column, percent: int) -> Column:
    return 100 * F.least(na, nb) >= percent * F.greatest(na, nb)


_SKETCH = common.schema(doc_id="long", n="long", digest="binary", registers="binary")
_SKETCH_ARROW = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("registers", pa.binary())])


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, set size, a 128-bit digest of the set and its registers (null for an empty set), stored."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.begin()
        for b in batches:
            for i in range(0, b.num_rows, 1000):
                own = b.slice(i, 1000)
                n, digest, regs = [], [], []
                for t in own.column(1).cast(pa.binary()).to_pylist():
                    s = shingles(t, width)
                    n.append(len(s))
                    digest.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                    regs.append(sketch(s).tobytes() if len(s) else None)
                yield pa.RecordBatch.from_arrays([own.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(regs, pa.binary())], schema=_SKETCH_ARROW)
        common.trim()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return common.stored(rows.mapInArrow(task, _SKETCH), "sketches")


def _bands(reps: DataFrame) -> DataFrame:
    """(key, band, id) for each band of each class's sketch."""
    arrow = pa.schema([("key", pa.int64()), ("band", pa.int32()), ("id", pa.int64())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 2000):
                own = b.slice(i, 2000)
                regs = np.frombuffer(b"".join(own.column(1).to_pylist()), "<u2").reshape(own.num_rows, BUCKETS)
                ids = np.repeat(own.column(0).to_numpy(zero_copy_only=False), BANDS)
                band = pa.array(np.tile(np.arange(BANDS, dtype="i4"), own.num_rows))
                yield pa.RecordBatch.from_arrays([pa.array(band_keys(regs).ravel()), band, pa.array(ids, pa.int64())], schema=arrow)
        common.trim()

    return reps.select("rep", "registers").mapInArrow(task, common.schema(key="long", band="int", id="long"))


def _likely_pairs(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b): those whose sizes and sketches allow a link."""
    side = lambda x: reps.select(F.col("rep").alias(x), F.col("n").alias(f"n{x}"), F.col("registers").alias(f"r{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").filter(_sizes_fit(F.col("na"), F.col("nb"), percent))
    arrow = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for i in range(0, x.num_rows, 2000):
                own = x.slice(i, 2000)
                ra, rb = (np.frombuffer(b"".join(own.column(k).to_pylist()), "<u2").reshape(own.num_rows, BUCKETS) for k in ("ra", "rb"))
                na, nb = (own.column(k).to_numpy(zero_copy_only=False) for k in ("na", "nb"))
                keep = pa.array(_likely(ra, rb, na, nb, percent))
                yield pa.RecordBatch.from_arrays([own.column("a").filter(keep), own.column("b").filter(keep)], schema=arrow)
        common.trim()

    return both.select("a", "b", "na", "nb", "ra", "rb").mapInArrow(task, common.schema(a="long", b="long"))


def _sets(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """The shingle sets of the documents whose id is in ``ids``."""
    arrow = pa.schema([("id", pa.int64()), ("items", pa.list_(pa.int64()))])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 500):
                own = b.slice(i, 500)
                sets = [shingles(t, width).view("i8") for t in own.column(1).cast(pa.binary()).to_pylist()]
                ends = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype("i4")
                items = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))
                yield pa.RecordBatch.from_arrays([own.column(0), items], schema=arrow)
        common.trim()

    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    return common.stored(rows.join(ids, "id", "left_semi").mapInArrow(task, common.schema(id="long", items="array<long>")), "sets")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have the similarity asked for."""
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("items").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("items").alias("sb")), "b")
    common_ = F.size(F.array_intersect("sa", "sb"))
    counted = both.select("a", "b", common_.alias("c"), (F.size("sa") + F.size("sb")).alias("n"))
    return counted.filter(100 * F.col("c") >= percent * (F.col("n") - F.col("c"))).select("a", "b")


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, least id of each one's component) of the links a - b."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    up = list(range(len(ids)))
    for x, y in zip(at[: len(a)].tolist(), at[len(a) :].tolist(), strict=True):
        while up[x] != x:
            up[x] = x = up[up[x]]
        while up[y] != y:
            up[y] = y = up[up[y]]
        if x != y:
            up[max(x, y)] = min(x, y)
    for x in range(len(up)):  # a parent is always smaller, so it is final already
        up[x] = up[up[x]]
    return ids, ids[np.array(up, "i8")] if len(ids) else ids


def _merged(links: DataFrame) -> DataFrame:
    """Each partition's links (u, v) as links from its ids to the least id that they reach there."""
    arrow = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        ids, root = _forest(*(np.concatenate(x) for x in zip(*held, strict=True))) if held else (np.zeros(0, "i8"),) * 2
        own = ids != root
        yield pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(root[own])], schema=arrow)

    return links.select("u", "v").mapInArrow(task, common.schema(u="long", v="long"))


def components(links: DataFrame, per_task: int = 250_000) -> DataFrame:
    """(id, comp) for every id in ``links`` (a, b) that has a partner: comp is the least id reachable.

    Tasks of ``per_task`` links each merge what they hold. If one task holds all, that is the answer; else alternating
    large-star and small-star steps on tables follow. These aggregate before they join, and nothing is collected.
    """
    links = common.stored(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), "links")
    parts = max(1, -(-links.count() // per_task))
    links = common.stored(_merged(links.coalesce(1) if parts == 1 else links.repartition(parts)), "links")
    sums = (F.count("*"), F.sum(F.hash("u", "v").cast("decimal(20,0)")))
    state = None if parts > 1 else links.agg(*sums).first()
    while parts > 1:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = common.stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = common.stored(large, "large")  # every row points down: v < u
        least = common.stored(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        links = common.stored(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        if (after := links.agg(*sums).first()) == state:
            break
        state = after
    roots = links.select(F.col("v").alias("id")).distinct()
    return links.select(F.col("u").alias("id"), F.col("v").alias("comp")).unionByName(roots.select("id", F.col("id").alias("comp")))


def _linked(ids: np.ndarray, comp: np.ndarray, n: np.ndarray, regs: np.ndarray, sets: list[np.ndarray], sides: tuple[np.ndarray, np.ndarray], band: int, percent: int) -> list[tuple[int, int]]:
    """Links between rows of the two sides that are in different components; one for each two components that meet.

    A pair is tested in the first band that it shares, so other buckets need not test it again.
    """
    up = {c: c for c in comp.tolist()}

    def top(c: int) -> int:
        while up[c] != c:
            up[c] = c = up[up[c]]
        return c

    bands, found = regs[:, : BANDS * ROWS].reshape(len(ids), BANDS, ROWS), []
    left, right = sides
    for a in left:
        b = right[(comp[right] != comp[a]) & ((ids[right] > ids[a]) if left is right else True)]
        b = b[100 * np.minimum(n[b], n[a]) >= percent * np.maximum(n[b], n[a])]
        if len(b) and band:
            b = b[~(bands[b, :band] == bands[a, :band]).all(axis=2).any(axis=1)]
        if len(b):
            b = b[_likely(regs[b], regs[a], n[b], np.full(len(b), n[a]), percent)]
        for k in b.tolist():
            x, y = top(int(comp[a])), top(int(comp[k]))
            if x == y:
                continue
            c = len(np.intersect1d(sets[a], sets[k], assume_unique=True))
            if 100 * c >= percent * (n[a] + n[k] - c):
                up[max(x, y)] = min(x, y)
                found.append((int(ids[a]), int(ids[k])))
    return found


def _blockwise(members: DataFrame, percent: int) -> DataFrame:
    """Links between components inside large buckets, of (key, band, m, id, comp, n, registers, items), block by block."""
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    rows = members.withColumn("own", F.pmod(F.xxhash64("id"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = pdf["i"].iloc[0], pdf["j"].iloc[0]
        regs = np.frombuffer(b"".join(pdf["registers"]), "<u2").reshape(len(pdf), BUCKETS)
        n, comp, ids, own = (pdf[c].to_numpy() for c in ("n", "comp", "id", "own"))
        left = np.flatnonzero(own == i)
        right = left if i == j else np.flatnonzero(own == j)
        found = _linked(ids, comp, n, regs, [np.asarray(x) for x in pdf["items"]], (left, right), int(pdf["band"].iloc[0]), percent)
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return rows.groupBy("key", "i", "j").applyInPandas(compare, common.schema(a="long", b="long"))


def _mixed(open_: DataFrame, comps: DataFrame) -> DataFrame:
    """The buckets' members with their components (comp), where a bucket still has members of several."""
    named = open_.join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    mixed = named.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x <> y").select("key")
    return common.stored(named.join(mixed, "key", "left_semi"), "mixed")


def _led(named: DataFrame, *rank: Column) -> DataFrame:
    """Pairs (a, b) of each bucket's first member by ``rank`` with its members of other components."""
    first = F.struct(*[c.alias(f"r{i}") for i, c in enumerate(rank)], "id", "comp")
    lead = named.groupBy("key").agg(F.min(first).alias("s")).select("key", F.col("s.id").alias("lead"), F.col("s.comp").alias("own"))
    return named.join(lead, "key").filter("comp <> own").select(F.least("id", "lead").alias("a"), F.greatest("id", "lead").alias("b")).distinct()


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Documents are linked when 100 x intersection >= percent x union of their sets of ``width``-word shingles;
    component_id is the least doc_id reachable. Null, empty and blank texts have no shingles and are linked with
    nothing. A null doc_id is linked with nothing: its component_id is null, and it is kept. Rows that repeat a doc_id
    are one document. Other columns are ignored. An empty table gives no rows.
    """
    common.ship(docs.sparkSession)
    with common.scratch(docs.sparkSession):
        return common.stored(_judged(docs, width, percent), "near", keep=True)


def _judged(docs: DataFrame, width: int, percent: int) -> DataFrame:
    all_ = sketches(docs, width)
    live = all_.filter("digest is not null and doc_id is not null")
    copies = common.stored(live.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("c")).filter("c > 1").drop("c"), "copies")
    classes = common.stored(live.join(copies, "digest", "left").select("doc_id", "n", F.coalesce("rep", "doc_id").alias("rep"), F.when(F.coalesce("rep", "doc_id") == F.col("doc_id"), F.col("registers")).alias("registers")), "classes")
    reps = classes.filter("registers is not null").select("rep", "n", "registers")

    bands = common.stored(_bands(reps), "bands")
    shared = bands.groupBy("key").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.count("*").alias("m")).filter("least <> most")
    open_ = common.stored(bands.join(common.stored(shared.select("key", "m"), "shared"), "key"), "buckets")
    members = common.few(common.stored(open_.select("id").distinct(), "members"))
    sets = _sets(docs, members, width)
    reps = common.stored(reps.join(members.withColumnRenamed("id", "rep"), "rep", "left_semi"), "registers")

    # first a few bands with the least id of a bucket as its leader: that merges most of every group
    named = open_.filter(F.col("band") < FIRST_BANDS).withColumn("comp", F.col("id"))
    links = common.stored(_confirmed(_likely_pairs(_led(named, F.col("id")), reps, percent), sets, percent), "confirmed")
    comps = common.stored(components(links), "components")
    # then all buckets that still hold several components, led by a member that has been merged, if there is one
    named = _mixed(open_, comps)
    alone = (F.col("comp") == F.col("id")).cast("int")
    links = links.unionByName(common.stored(_confirmed(_likely_pairs(_led(named, alone, F.xxhash64("id")), reps, percent), sets, percent), "confirmed"))
    comps = common.stored(components(links), "components")
    # then every open pair: listed in small buckets, block against block in large ones
    named = _mixed(open_, comps)
    few, many = named.filter(F.col("m") <= LISTED), named.filter(F.col("m") > LISTED)
    other = few.select("key", F.col("id").alias("b"), F.col("comp").alias("other"))
    pairs = few.select("key", F.col("id").alias("a"), "comp").join(other, "key").filter("a < b and comp <> other").select("a", "b").distinct()
    full = many.join(reps.select(F.col("rep").alias("id"), "n", "registers"), "id").join(sets, "id")
    rest = _confirmed(_likely_pairs(pairs, reps, percent), sets, percent).unionByName(_blockwise(full, percent))
    comps = common.stored(components(links.unionByName(rest)), "components")

    named = classes.select("doc_id", "n", "rep").join(comps.withColumnRenamed("id", "rep"), "rep", "left")
    named = named.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("comp", "rep").alias("component_id"))
    alone = all_.filter("digest is null or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    out = named.unionByName(alone)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def distinct(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row of each near-duplicate group, with all its columns: the least doc_id's; of rows that repeat it, the one with
    the least hash of its text. Rows without an id all stay."""
    judged = near_duplicates(docs, width, percent).filter("doc_id is not null")
    repeated = judged.groupBy("doc_id").count().filter("count > 1").limit(1).count()
    gone = common.few(common.stored(judged.filter("not kept").select(F.col("doc_id").alias("gone_id")).distinct(), "gone"))
    kept = docs.join(gone, docs["doc_id"].cast("long") == gone["gone_id"], "left_anti")  # rows without an id stay
    if repeated:
        from pyspark.sql import Window as W

        place = common._fresh("place_", kept.columns)
        first = F.row_number().over(W.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text"))
        one = kept.filter("doc_id is not null").withColumn(place, first).filter(F.col(place) == 1).drop(place)
        kept = one.unionByName(kept.filter("doc_id is null"))
    return kept
