"""The pipeline's stages on a folder of tables with planted cases."""

from __future__ import annotations

import pytest
from data_for_tests import edited, prose

import corpus_pipeline
from sievelight.llm import common


@pytest.fixture(scope="module")
def folder(spark, sf, tmp_path_factory):
    out = f"file://{tmp_path_factory.mktemp('tables')}"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").first()["text"]
    own = prose(1, 300)
    extra = [(10_000, own), (10_001, own), (10_002, edited(own, 3, 2)), (10_003, f"{prose(2, 60)} {bench} {prose(3, 60)}"), (10_004, None), (10_005, "")]
    more = spark.createDataFrame([(d, t, "en", "src0", len(t or "")) for d, t in extra], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.unionByName(more.select(*[more[c].cast(t) for c, t in docs.dtypes])).write.parquet(f"{out}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{sf}/{t}.parquet").write.parquet(f"{out}/{t}.parquet")
    return out


def test_stages(spark, folder):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "quality", "near_duplicates", "decontamination", "packing"]
    docs = common.table(spark, folder, "documents")
    columns, seen = docs.columns, {}
    for n, stage in corpus_pipeline.STAGES:
        docs = common.stored(stage(spark, docs, folder), n)
        seen[n] = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert n == "packing" or docs.columns == columns
    assert {10_000, 10_001, 10_002, 10_003} <= seen["toxicity"]
    assert {10_000, 10_001} & seen["near_duplicates"] == {10_000} and 10_002 not in seen["near_duplicates"]
    assert 10_003 in seen["near_duplicates"] and 10_003 not in seen["decontamination"]
    assert seen["packing"] == seen["decontamination"] < seen["toxicity"]


def test_run(spark, folder):
    got = corpus_pipeline.run(spark, folder)
    assert got.count() > 0 and corpus_pipeline.ORACLE_SQL is None
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in got.select("doc_id").collect()}
    good = [d for d, r in labels.items() if r["quality"] == 1 and r["toxic"] == 0]
    assert sum(labels[d]["quality"] == 0 for d in kept if d in labels) <= 2
    assert len([d for d in good if d in kept]) > 0.7 * len(good)


def test_empty_tables_repeats_and_other_columns(spark, sf, tmp_path):
    """Nothing gives nothing; rows that repeat an id are one document, rows without an id each stay; columns named as ours
    pass through the stages."""
    kinds = {"documents": "doc_id bigint, text string, score double, text_ string, gone_id int, place_ int", "labels": "doc_id bigint, quality int, toxic int", "benchmark": "item_id bigint, text string"}

    def tables(at, **rows):
        for t, kind in kinds.items():
            spark.createDataFrame(rows.get(t, []), kind).write.parquet(f"{at}/{t}.parquet")
        return str(at)

    assert corpus_pipeline.run(spark, tables(tmp_path / "none")).count() == 0
    texts = [(i, prose(40 + i, 60)) for i in range(12)]
    rows = [*texts, texts[3], texts[3], (3, prose(99, 50)), (None, prose(77, 50)), (None, None), (50, ""), (51, edited(texts[5][1], 1, 1)), (60, texts[7][1] + " " + prose(500, 20))]
    docs = [(d, t, 0.5, "x", 1, 2) for d, t in rows]
    labels = [(i, 1, 0) for i in range(12)] + [(None, 0, 1)]
    got = corpus_pipeline.run(spark, tables(tmp_path / "some", documents=docs, labels=labels, benchmark=[(1, prose(500, 20)), (None, None)])).collect()
    kept = {r["doc_id"] for r in got}
    assert 60 not in kept and 51 not in kept and kept <= {d for d, _ in rows}
    assert sum(r["start"] == 0 for r in got if r["doc_id"] == 3) == (3 in kept)
