"""URL rules in a sorted digest array.

The rules' 64-bit xxhash keys are sorted into one file, with the full rule strings behind them. Executors get the file
from Spark's file server, map it into memory, probe it by vectorised binary search and confirm each hit against the
stored string, so a collision of digests changes nothing.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
import tempfile
from collections.abc import Iterable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelight.llm import common

MAGIC = b"SVDIGST1"
#: Rules in the array; more than this are refused, as every executor holds a copy (about 60 bytes a rule).
MAX_RULES = 20_000_000


def split_rule(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host, slash + path


def write_array(rules: Iterable[tuple[str, str]], path: str) -> None:
    """Write (rule, verdict) pairs; of a rule that is given twice, the last verdict holds.

    Layout: magic, rules, lengths; then sorted digests (u64), verdicts (u8), string ends (u64), lengths of the rules'
    paths that occur (u32), the strings.
    """
    held = dict(rules)
    if len(held) > MAX_RULES:
        raise ValueError(f"{len(held)} rules; a digest array takes {MAX_RULES}")
    keys = sorted(held, key=lambda r: (xxhash.xxh64_intdigest(r), r))
    raw = [k.encode() for k in keys]
    lengths = sorted({len(split_rule(k)[1]) for k in keys})
    with open(path, "wb") as f:
        f.write(MAGIC + struct.pack("<QQ", len(keys), len(lengths)))
        f.write(np.array([xxhash.xxh64_intdigest(k) for k in keys], "<u8").tobytes())
        f.write(np.cumsum([len(r) for r in raw], dtype="<u8").tobytes())
        f.write(np.array(lengths, "<u8").tobytes())
        f.write(np.array([held[k] == "allow" for k in keys], "u1").tobytes())
        f.write(b"".join(raw))


class DigestArray:
    """A mapped array; ``find`` gives each string's rule number or -1."""

    def __init__(self, path: str):
        raw = np.memmap(path, "u1", "r")
        if raw[:8].tobytes() != MAGIC:
            raise ValueError("not a digest array")
        n, m = struct.unpack("<QQ", raw[8:24].tobytes())
        self.digests = raw[24 : 24 + 8 * n].view("<u8")
        self.ends = raw[24 + 8 * n : 24 + 16 * n].view("<u8")
        self.lengths = raw[24 + 16 * n : 24 + 16 * n + 8 * m].view("<u8").astype("i8").tolist()
        self.allow = raw[24 + 16 * n + 8 * m : 24 + 17 * n + 8 * m]
        self.strings = raw[24 + 17 * n + 8 * m :]

    def rule(self, i: int) -> str:
        return self.strings[int(self.ends[i - 1]) if i else 0 : int(self.ends[i])].tobytes().decode()

    def find(self, texts: list[str]) -> np.ndarray:
        out = np.full(len(texts), -1, "i8")
        if not texts or not len(self.digests):
            return out
        keys = np.fromiter(map(xxhash.xxh64_intdigest, texts), "u8", len(texts))
        at = np.searchsorted(self.digests, keys)
        hits = np.flatnonzero(self.digests[np.minimum(at, len(self.digests) - 1)] == keys)
        for i in hits:
            k = int(at[i])
            while k < len(self.digests) and self.digests[k] == keys[i]:  # rules of one digest stand together
                if self.rule(k) == texts[i]:
                    out[i] = k
                    break
                k += 1
        return out

    def longest(self, hosts: list[str], paths: list[str]) -> np.ndarray:
        """For each URL the number of the longest rule that fits, or -1. Ties: the longer host."""
        names, back = np.unique(np.array(hosts, dtype=object), return_inverse=True) if hosts else ([], [])
        parents = [[".".join(h.split(".")[i:]) for i in range(h.count(".") + 1)] for h in names]
        owner, probe = [], []
        for i, (h, p) in enumerate(zip(back, paths, strict=True)):
            for s in parents[h]:
                if not s:
                    continue
                for n in self.lengths:
                    if n <= len(p):
                        owner.append(i)
                        probe.append(s + p[:n])
        found = self.find(probe)
        best, size = np.full(len(hosts), -1, "i8"), np.zeros(len(hosts), "i8")
        for k in np.flatnonzero(found >= 0):  # a host's own rules come before its parents'
            i = owner[k]
            if len(probe[k]) > size[i]:
                best[i], size[i] = found[k], len(probe[k])
        return best


@lru_cache(maxsize=4)
def _mapped(path: str) -> DigestArray:
    return DigestArray(path)


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://`` or for null."""
    there = url.isNotNull() & url.contains("://")
    rest = F.substr(url, F.instr(url, "://") + 3)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    path = F.when(F.regexp_extract(rest, r"(?s)^[^/?#]*([/?#]?)", 1) == "/", path).otherwise("")
    empty = F.lit("")
    return F.when(there, host).otherwise(empty), F.when(there, path).otherwise(empty)


def judge(pages: DataFrame, rules: Iterable[tuple[str, str]], default: str = "allow", key: str = "page_id") -> DataFrame:
    """Judge every URL of ``pages`` (key, url) by (rule, verdict) pairs.

    A rule is ``host/path``: it fits the host and its subdomains where the URL's path starts with the rule's; the
    longest wins. Where none fits, the rule is null and the verdict is ``default``. Returns key, host, path, rule,
    verdict; other columns are ignored, repeated rows and null keys are kept.
    """
    spark = pages.sparkSession
    common.ship(spark)
    local = os.path.join(tempfile.mkdtemp(), "rules")
    write_array(rules, local)
    name = f"rules-{hashlib.sha256(Path(local).read_bytes()).hexdigest()[:16]}.digests"
    os.rename(local, named := os.path.join(os.path.dirname(local), name))
    if name not in {os.path.basename(re.sub(r"\?.*", "", x)) for x in spark.sparkContext.listFiles}:
        spark.sparkContext.addFile(named)  # later executors fetch it too
    host, path = host_path(F.col("url").cast("string"))
    rows = pages.select(F.col(key), host.alias("host"), path.alias("path"))
    schema = rows.select("*", F.lit("").alias("rule"), F.lit("").alias("verdict")).schema
    for f in schema:
        f.nullable = True

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import SparkFiles

        array = _mapped(SparkFiles.get(name))
        for b in batches:
            at = array.longest(b.column("host").to_pylist(), b.column("path").to_pylist())
            rule = [array.rule(k) if k >= 0 else None for k in at.tolist()]
            verdict = [default if k < 0 else "allow" if array.allow[k] else "block" for k in at.tolist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names=[*b.schema.names, "rule", "verdict"])

    return rows.mapInArrow(task, schema)
