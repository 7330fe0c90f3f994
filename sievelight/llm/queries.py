"""The queries opN_<name> over the tables of a folder, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelight.llm import ann, common, decontam, hmm, neardup, packing, pfor, quality, sharding, toxicity, urlfilter


def op1_cgk_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


#: The rules that op2 judges by.
URL_RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))


URL_SQL = r"""
WITH parts AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), split AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1), '') AS path
  FROM parts
), rules(rule, rhost, rpath, verdict) AS (VALUES
  ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'),
  ('example.org/en/1', 'example.org', '/en/1', 'block'), ('com/fr/', 'com', '/fr/', 'allow'), ('com/de/', 'com', '/de/', 'block')
)
SELECT s.page_id, s.host, s.path,
  (SELECT arg_max(rule, length(rule)) FROM rules r
   WHERE (s.host = rhost OR ends_with(s.host, '.' || rhost)) AND starts_with(s.path, rpath)) AS rule,
  coalesce((SELECT arg_max(verdict, length(rule)) FROM rules r
   WHERE (s.host = rhost OR ends_with(s.host, '.' || rhost)) AND starts_with(s.path, rpath)), 'allow') AS verdict
FROM split s
"""


def op2_digest_array_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(common.table(spark, sf_dir, "pages"), URL_RULES)


def op3_hilbert_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def _judged(scores: DataFrame, mod: int, held: int, least: float) -> DataFrame:
    held_out = F.coalesce(common.split_of("doc_id", mod) == held, F.lit(False))
    return scores.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))


def op4_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels, "quality", allowed=common.split_of("doc_id", 4) != 2)
    return _judged(quality.score(docs, model), 4, 2, 0.7)


def op5_hmm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, rest = common.table(spark, sf_dir, "documents"), common.split_of("doc_id", 10)
    out = hmm.language_model(docs, training=rest != 0)
    held_out = F.coalesce(common.split_of("doc_id", 10) == 0, F.lit(False)).alias("held_out")
    return out.select("doc_id", held_out, "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_subword_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels, "toxic", allowed=common.split_of("doc_id", 5) != 0)
    return _judged(toxicity.score(docs, model), 5, 0, 0.5)


def op7_pfor_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = common.new_path(spark, "pfor")
    files = pfor.write(common.table(spark, sf_dir, "documents"), folder, end_id=2)
    return pfor.read_digest(files, folder).select("doc_id", "start", "n_tokens", "ids_crc32")


def op8_kd_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(common.table(spark, sf_dir, "documents"), shards=8)


DEDUP_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), places AS (
  SELECT doc_id, ws, unnest(generate_series(1, greatest(1, len(ws) - 3))) AS i FROM w WHERE len(ws) > 0
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS shingle FROM places
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL
), e AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)
), both_ways AS (
  SELECT a, b FROM e UNION ALL SELECT b, a FROM e
), reach(doc_id, root) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT b, root FROM reach JOIN both_ways ON a = reach.doc_id
), c AS (
  SELECT doc_id, min(root) AS component_id FROM reach GROUP BY doc_id
)
SELECT c.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, c.doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)
"""


def op9_hyperminhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(common.table(spark, sf_dir, "documents"), width=4, percent=80)


def op10_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(common.table(spark, sf_dir, "documents"), end_id=0, capacity=1024)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_cgk_decontamination, op2_digest_array_urls, op3_hilbert_neighbours, op4_pu_quality, op5_hmm_scores, op6_subword_toxicity, op7_pfor_tokens, op8_kd_tree_shards, op9_hyperminhash_dedup, op10_harmonic_packing)}


def oracle_sql() -> dict[str, str]:
    return {"op2_digest_array_urls": URL_SQL, "op9_hyperminhash_dedup": DEDUP_SQL}
