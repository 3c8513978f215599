"""The corpus pipeline: language, near-duplicates, secrets, mixture, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept; all but the last return
the columns of documents. run() applies them to the documents table, writing and reading Parquet in between.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuewright.llm import byte_bpe, language_id, minhash, mixing, secrets
from cuewright.llm.common import dropped, written
from cuewright.session import table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A text goes if no language holds more than this share of it, or if it has no letter. Texts of two or three
#: languages with passages in common are clean, so only an even mixture of three or more is taken for noise.
LEAST_SHARE = 1 / 3
#: A text goes if a trigram is not likelier by this much (natural logarithm) in a learned language than in the background
#: model. Up to 4,000 texts each of sf0.001, sf0.01 and sf0.1 had at least 1.7, random letters at most 0.12.
LEAST_EVIDENCE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10. Rejects texts without letters, texts in no learned language, and texts of which no language holds more than a third.

    Learns from the non-null languages of the documents that are not held out; the texts alone are judged.
    Each row is judged by its text, whatever its id; a null text has no letter.
    """
    model = language_id.learn(docs.filter(~language_id.held_out(F.col("doc_id"))))
    rows = docs.select(F.struct(*COLUMNS).alias("row"))
    found = language_id.identify(rows, model, id_col="row", text_col="row.text")
    return found.filter((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") > LEAST_SHARE) & (F.col("evidence") > LEAST_EVIDENCE)).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5, five words, similarity 0.8: one document of each group stays, that with the smallest key.

    A key is the id, nulls last, and a digest of the text: rows that share it repeat both, and one of them stays.
    Texts without words are linked with nothing and stay.
    """
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.sha2("text", 256).alias("digest"))
    keyed = docs.select(*COLUMNS, key.alias("key"))
    found = minhash.near_duplicates(keyed, shingle=5, similarity=(80, 100), id_col="key").filter("kept").select(F.col("key").alias("kept_key")).distinct()
    return keyed.join(found, F.col("key") == F.col("kept_key"), "left_semi").select(*COLUMNS).dropDuplicates(["doc_id", "text"])


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: every span that the scan finds is replaced by [SECRET]; no document goes."""
    rows = docs.select(F.struct("doc_id", "lang", "source", "n_chars").alias("row"), "text")
    cleaned = secrets.scan(rows, id_col="row", redacted="cleaned")
    length = F.when(F.size("spans") > 0, F.char_length("cleaned").cast("bigint")).otherwise(F.col("row.n_chars"))
    return cleaned.select("row.doc_id", F.col("cleaned").alias("text"), "row.lang", "row.source", length.alias("n_chars"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: all sources weigh the same (null is one); a document is repeated as its draw says, and rows are shuffled.

    Null and empty texts are documents like others; rows without an id draw by their text; repeated rows draw alike, each for itself.
    """
    return mixing.mix(docs).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: ids of every text, with digests of the ids and of the bytes they decode to.

    One row per row: a null or empty text has no ids, null ids and repeated rows are kept, a text of any length is encoded whole.
    """
    return byte_bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("without_secrets", without_secrets), ("mixture", mixture), ("tokens", tokens)]
#: Models, registers and byte-pair merges have no SQL form; tests compare run() with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, written(stage(spark, docs, sf_dir), f"stage-{name}")
        if i:
            dropped(before)
    return STAGES[-1][1](spark, docs, sf_dir)
