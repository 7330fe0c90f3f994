from __future__ import annotations

from zlib import crc32

import pytest
from data_for_tests import ODD, prose

from sievelight.llm import sharding


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_near_equal_bytes(make, shards):
    rows = [(i, prose(i % 50, 5 + i % 90)) for i in range(600)] + [(i, "the same text for all " * 3) for i in range(1000, 1300)]
    got = sharding.shard(make(rows).repartition(4), shards).toPandas()
    size = got.groupby("shard")["size"].sum()
    assert list(size.index) == list(range(shards))
    largest = max(len(t) + 1 for _, t in rows)
    assert size.max() - size.min() <= 3 * largest
    assert all(sorted(x.slot) == list(range(len(x))) for _, x in got.groupby("shard"))
    assert sorted(zip(got.doc_id, got["size"], got.text_crc32, strict=True)) == sorted((d, len(t.encode()) + 1, crc32(t.encode())) for d, t in rows)
    assert set(got.law) == {"bytes"} and got.grown_shard.isna().all()


def test_leaves_of_a_target_size(make):
    rows = [(i, prose(i, 20)) for i in range(200)]
    total = sum(len(t) + 1 for _, t in rows)
    got = sharding.shard(make(rows), target_bytes=total // 5 + 1).toPandas().groupby("shard")["size"].sum()
    assert len(got) == 5 and got.max() <= total // 5 + 400


def test_equal_rows_and_odd_rows(make):
    same = sharding.shard(make([(1, "a")] * 64), 4).toPandas()
    assert len(same) == 64 and same["shard"].nunique() == 1  # rows that nothing tells apart stay together
    got = sharding.shard(make(ODD), 2).collect()
    assert len(got) == len(ODD) and {(r["doc_id"], r["size"]) for r in got} >= {(1, 1), (2, 1), (5, 200_001)}
    assert all(r["text_crc32"] == 0 for r in got if r["doc_id"] in (1, 2))
    assert sharding.shard(make([])).count() == 0


def test_other_dimensions(make):
    rows = [(i, prose(i, 20)) for i in range(200)]
    got = sharding.shard(make(rows), 4, ("key", "score", "size", "absent")).toPandas()
    assert got.groupby("shard")["size"].sum().std() < 300
