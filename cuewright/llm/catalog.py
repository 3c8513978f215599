"""Queries of the ten operators and of the pipeline, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuewright.llm import byte_bpe, language_id, minhash, mixing, neighbors, pii, secrets, token_counts, token_store, topk
from cuewright.llm.common import scratch_path, spans_text
from cuewright.session import table

BYTE_VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, similarity=(80, 100))


def op6_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbors.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.9)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] != "context")
    return found.select(
        "doc_id",
        *(secrets.counted("spans", kind).alias(f"n_{kind}") for kind in ("email", "ip", "card", "phone")),
        F.sha2(spans_text(base), 256).alias("base_sha256"),
        spans_text(F.col("spans")).alias("spans"),
    )


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), WORD_VOCABULARY, limit=2048)


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_documents(table(spark, sf_dir, "documents"), BYTE_VOCABULARY, public_tokenizers.PATTERN, keep_ids=False)


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] != "field")
    return found.select(
        "doc_id",
        *(secrets.counted("spans", kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")),
        F.sha2(spans_text(base), 256).alias("base_sha256"),
        spans_text(F.col("spans")).alias("spans"),
    )


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.search(vectors, vectors.filter(F.col("vec_id") % 50 == 0), k=5, scale=256)


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-store")
    token_store.write_store(table(spark, sf_dir, "documents"), path, WORD_VOCABULARY, end_id=1)
    return token_store.read_checksums(spark, path)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.learn(docs.filter(~language_id.held_out(F.col("doc_id"))))
    found = language_id.identify(docs, model)
    return found.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_byte_bpe": op1_byte_bpe,
        "op2_secrets": op2_secrets,
        "op3_topk": op3_topk,
        "op4_token_store": op4_token_store,
        "op5_minhash": op5_minhash,
        "op6_neighbors": op6_neighbors,
        "op7_pii": op7_pii,
        "op8_mixing": op8_mixing,
        "op9_token_counts": op9_token_counts,
        "op10_language_id": op10_language_id,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_topk": topk.ORACLE_SQL, "op8_mixing": mixing.ORACLE_SQL}
