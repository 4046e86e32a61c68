"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chatfmt, langid, licenses, minhash, mixing, pii, simhash, toxicity, vafile
from .common import documents


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir), width=4, percent=80).select("doc_id", "n_shingles", "component_id", "kept")


def op2_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode_digests(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_documents(documents(spark, sf_dir))


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vafile.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 20 == 0, k=20)


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chatfmt.rendered(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.documents_with_licenses(documents(spark, sf_dir))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.compare_edited(documents(spark, sf_dir))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.spans(documents(spark, sf_dir))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = (
    op1_minhash_near_dedup, op2_byte_level_bpe, op3_toxicity, op4_language_id, op5_exact_top_k,
    op6_chat_formatting, op7_license_scan, op8_simhash, op9_pii, op10_mixing,
)

OP5_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.r AS r, q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.r <> c.r
), r AS (
  SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 20
"""

OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
), s AS (
  SELECT r, doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) END AS ss
  FROM w
), n AS (SELECT r, doc_id, len(ss) AS n_shingles FROM s),
e AS (SELECT r, unnest(ss) AS g FROM s),
p AS (
  SELECT a.r AS a, b.r AS b, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.r <> b.r GROUP BY 1, 2
), l AS (
  SELECT a, b FROM p JOIN n x ON x.r = a JOIN n y ON y.r = b
  WHERE 100 * c >= 80 * (x.n_shingles + y.n_shingles - c)
), t AS (
  SELECT r AS a, r AS b FROM n UNION SELECT t.a, l.b FROM t JOIN l ON t.b = l.a
), k AS (SELECT t.a AS r, min(n.doc_id) AS component_id FROM t JOIN n ON n.r = t.b GROUP BY t.a)
SELECT doc_id, n_shingles::BIGINT AS n_shingles, component_id, component_id = doc_id AS kept FROM n JOIN k USING (r)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op1_minhash_near_dedup": OP1_SQL, "op5_exact_top_k": OP5_SQL, "op6_chat_formatting": chatfmt.ORACLE_SQL}
