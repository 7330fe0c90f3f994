"""A corpus pipeline of the operators in ``sievelight.llm``: each stage takes the documents that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sievelight.llm import common, decontam, neardup, packing, quality, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is under 0.5, by a model of the labelled documents."""
    model = toxicity.fit(docs, common.table(spark, sf_dir, "labels"), "toxic")
    return toxicity.clean(docs, model, below=0.5)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality is 0.7 or more, by a model of trusted positives and unlabelled documents."""
    model = quality.fit(docs, common.table(spark, sf_dir, "labels"), "quality")
    return quality.good(docs, model, least=0.7)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least doc_id of each group of near duplicates: five words, similarity 0.8."""
    return neardup.distinct(docs, width=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, up to a fifth of its words edited."""
    return decontam.clean(docs, common.table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 tokens."""
    return packing.pack(docs, end_id=0, capacity=1024, cached=100_000)  # workers hold what earlier stages left


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("packing", pack),
]

#: Trained models and edit distances have no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is written as Parquet and read again by the next."""
    docs = common.table(spark, sf_dir, "documents")
    with common.scratch(spark):  # the last stage has read its documents when it returns
        for name, stage in STAGES[:-1]:
            docs = common.stored(stage(spark, docs, sf_dir), name)
        return STAGES[-1][1](spark, docs, sf_dir)
