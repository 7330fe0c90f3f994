"""Encoding, files and packing, against the library and by exact round trips."""

from __future__ import annotations

import io
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from data_for_tests import ODD, prose

from sievelight.llm import common, packing, pfor, tokenization


@pytest.fixture(scope="module")
def encoder():
    return tokenization.Encoder(tokenization.default_path(), limit=500)


def plain(encoder, texts):
    return [np.array(e.ids, "<u4") for e in encoder.whole.encode_batch([t or "" for t in texts], add_special_tokens=False)]


ALPHABET = st.one_of(st.sampled_from(list(" \n\t\r .,!'s1aZñ-|中\x00  ")), st.characters(codec="utf-8"))


@given(st.lists(st.text(ALPHABET, max_size=40), max_size=8))
@settings(max_examples=300, deadline=None)
def test_encoder_equals_the_library(encoder, texts):
    assert encoder.encode(texts) == [x.tobytes() for x in plain(encoder, texts)]


def test_added_tokens_and_other_files_go_through_the_library(tmp_path):
    """Against a tokenizer that nothing has touched, with its special tokens; and files that no piece may be cut from."""
    from tokenizers import Tokenizer, normalizers, pre_tokenizers

    path = tokenization.default_path()
    texts = ["x <|endoftext|> y", "<|endoftext|>", "a b <|endoftext|>  c", "<|endof text|> two  blanks", None, "", prose(1, 40)]
    library = lambda t: [np.array(t.encode(x or "", add_special_tokens=False).ids, "<u4").tobytes() for x in texts]
    whole = Tokenizer.from_file(path)
    own = tokenization.Encoder(path)
    assert own.plain and own.encode(texts) == library(whole)
    assert 50256 in np.frombuffer(own.encode(texts)[0], "<u4")
    for k, change in enumerate((lambda t: setattr(t, "normalizer", normalizers.Lowercase()), lambda t: setattr(t, "pre_tokenizer", pre_tokenizers.ByteLevel(add_prefix_space=True)))):
        other = Tokenizer.from_file(path)
        change(other)
        other.save(str(at := tmp_path / f"{k}.json"))
        assert not (own := tokenization.Encoder(str(at))).plain and own.encode(texts) == library(other)


def test_encoder_forgets_and_relearns(encoder):
    texts = [prose(i, 300) + f" only{i} here{i}ever" for i in range(30)]
    for _ in range(2):
        assert encoder.encode(texts) == [x.tobytes() for x in plain(encoder, texts)]


@given(st.lists(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 60), max_size=60), max_size=12), st.sampled_from([8, 64, 512]), st.floats(0, 1))
@settings(max_examples=200, deadline=None)
def test_file_round_trip(docs, block, percentile):
    raw = io.BytesIO()
    raw.close, held = (lambda: None), raw
    w = pfor.Writer(held, block, percentile, chunk=block * 2)
    for i, d in enumerate(docs):
        w.add(None if i % 5 == 3 else i, np.array(d, "<u4"))
    w.close()

    class File(io.BytesIO):
        def size(self):
            return len(self.getvalue())

    r = pfor.Reader(File(raw.getvalue()))
    got = list(r.documents(chunk=16))
    assert [(d, x.tolist()) for d, _, x in got] == [(None if i % 5 == 3 else i, d) for i, d in enumerate(docs)]
    flat = [x for d in docs for x in d]
    for a in range(0, len(flat), 7):
        assert r.read(a, 11).tolist() == flat[a : a + 11]


def test_outliers_are_patched():
    ids = np.full(512, 7, "<u4")
    ids[[3, 500]] = [70_000, 2**32 - 1]
    packed, low, width, counts = pfor.encode_blocks(ids)
    assert width.tolist() == [0] and counts.tolist() == [2] and low.tolist() == [7] and len(packed[0]) == 2 * 6


def test_written_ids(spark, make, encoder):
    rows = [*ODD, *[(100 + i, prose(i, 50 + i)) for i in range(20)]]
    folder = common.new_path(spark, "test")
    got = pfor.read_digest(pfor.write(make(rows).repartition(3), folder), folder).collect()
    want, at = [], 0
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.append(plain(encoder, [t])[0], 2).astype("<u4")
        want.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(repr, (tuple(r)[:4] for r in got))) == sorted(map(repr, want))


def test_nothing_to_write(spark, make):
    folder = common.new_path(spark, "test")
    assert pfor.read_digest(pfor.write(make([]), folder), folder).count() == 0
    assert packing.pack(make([])).count() == 0


def test_many_small_files_are_read_by_few_tasks(spark, make, encoder, tmp_path):
    texts = [f"text {i} of many" for i in range(200)]
    folder = f"file://{tmp_path}/ids"
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        files = pfor.write(make(list(enumerate(texts))), folder)
        got = pfor.read_digest(files, folder)
        rows, parts = sorted(got.collect()), got.rdd.getNumPartitions()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    ids = [x + np.array([2], "<u4").tobytes() for x in encoder.encode(texts)]
    starts = np.cumsum([0, *[len(x) // 4 for x in ids]]).tolist()
    assert [tuple(r[:4]) for r in rows] == [(i, starts[i], len(x) // 4, zlib.crc32(x)) for i, x in enumerate(ids)]
    assert files.count() > 20 and len(list((tmp_path / "ids/table").glob("*.parquet"))) == 1
    assert parts <= spark.sparkContext.defaultParallelism


def test_cut():
    assert packing.cut(2048 + 700, 1024, 64) == [1024, 1024, 512, 128, 60]
    assert packing.cut(1, 1024, 64) == [1] and packing.cut(1024, 1024, 64) == [1024]


@pytest.mark.parametrize("capacity,grain", [(1024, 64), (64, 8), (16, 1)])
def test_packed_pieces(make, encoder, capacity, grain):
    rows = [*ODD[:4], *ODD[6:], *[(100 + i, prose(i, 3 + 7 * i)) for i in range(60)]]
    got = packing.pack(make(rows).repartition(5), capacity=capacity, grain=grain).toPandas()
    ids = {d: np.append(plain(encoder, [t])[0], 0).astype("<u4") for d, t in rows}
    assert set(got.doc_id) == set(ids)
    for d, own in got.sort_values("start").groupby("doc_id"):
        assert own.start.tolist() == (np.cumsum(own.length) - own.length).tolist()
        assert own.length.sum() == len(ids[d]) == own.doc_tokens.iloc[0]
        assert own.ids_crc32.tolist() == [zlib.crc32(ids[d][a : a + n].tobytes()) for a, n in zip(own.start, own.length, strict=True)]
    total = got.groupby("sequence_id").length.sum()
    assert sorted(total.index) == list(range(len(total))) and total.max() <= capacity
    for _, own in got.sort_values("offset").groupby("sequence_id"):
        assert own.offset.tolist() == (np.cumsum(own.length) - own.length).tolist()
    padding = sum(0 if n & (n - 1) == 0 else capacity - n for n in total)
    assert padding <= 0.05 * total.sum() + capacity
