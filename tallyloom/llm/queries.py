"""The thin ``opN_<name>`` queries over the standard tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import documents, shared_dir, table
from tallyloom.llm.exact_dedup import exact_dedup
from tallyloom.llm.langid import identify, page_evidence, train_text_model
from tallyloom.llm.line_dedup import line_groups
from tallyloom.llm.lm import lm_scores
from tallyloom.llm.mixing import mix
from tallyloom.llm.packing import pack
from tallyloom.llm.secrets import corpus_words, labelled_findings, scan, train_scanner
from tallyloom.llm.simhash import simhash_groups
from tallyloom.llm.token_output import read_documents, write_tokens
from tallyloom.llm.topk import exact_topk

WORD_BPE, BYTE_BPE = "word_bpe_49k.json", "byte_bpe_50k.json"


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir), digest=True)


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    shards = write_tokens(docs, shared_dir(spark), vocabulary(WORD_BPE), end_id=2)
    return read_documents(shards, docs.schema["doc_id"].dataType.simpleString())


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk(table(spark, sf_dir, "embeddings"), 5, F.col("vec_id") % 50 == 0)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), vocabulary(BYTE_BPE), end_id=1)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "copies", "source")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(documents(spark, sf_dir))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2
    return lm_scores(documents(spark, sf_dir), held)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)  # without paths
    words = corpus_words(docs)
    return scan(docs, train_scanner(words, labelled_findings(docs, words)))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = line_groups(documents(spark, sf_dir))
    return groups.select("doc_id", F.col("pos").alias("line_no"), F.col("keep_id").alias("keep_doc_id"), F.col("keep_pos").alias("keep_line_no"), "kept")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = identify(page_evidence(table(spark, sf_dir, "pages")), train_text_model(documents(spark, sf_dir)))
    return found.withColumnRenamed("id", "page_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_exact_dedup, op2_token_output, op3_exact_topk, op4_packing, op5_mixing, op6_simhash, op7_lm_scoring, op8_secret_scan, op9_line_dedup, op10_language_id)}


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": OP1, "op3_exact_topk": OP3}


OP1 = """
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""

OP3 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""
