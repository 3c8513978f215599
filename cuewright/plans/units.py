"""Queries of sentences, paragraphs and units."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuewright.functions import sentences as split
from cuewright.operators import units
from cuewright.session import table


def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of documents with their lengths."""
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(split.paragraphs(F.col("text"))).alias("i", "p")).select("doc_id", F.col("i").cast("long").alias("i"), F.length("p").alias("n"), F.md5("p").alias("digest"))


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sentences of documents, at most 400 characters each."""
    return split.sentence_rows(table(spark, sf_dir, "documents"), longest=400)


def pending_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs that no labelled document has, each once, by content."""
    every = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(split.paragraphs(F.col("text"))).alias("i", "p")).select(F.sha2(F.concat_ws("|", F.lit("v1"), "p"), 256).alias("key"), "doc_id", F.col("i").cast("long").alias("ordinal"))
    done = every.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    return units.pending(every, done)


PARAGRAPHS_SQL = r"""SELECT doc_id, i - 1 AS i, ps[i] AS p FROM (
  SELECT doc_id, ps, unnest(range(1, len(ps) + 1)) AS i FROM (
    SELECT doc_id, list_filter(list_transform(CASE WHEN regexp_matches(u, '\n[ \t]*\n') THEN regexp_split_to_array(u, '\n[ \t]*\n\s*') ELSE string_split(u, chr(10)) END, lambda p: trim(regexp_replace(p, '\s+', ' ', 'g'))), lambda p: p <> '') AS ps
    FROM (SELECT doc_id, regexp_replace(text, '\r\n?', chr(10), 'g') AS u FROM documents)))"""

SQL = {
    "paragraphs": f"SELECT doc_id, i, CAST(length(p) AS INTEGER) AS n, md5(p) AS digest FROM ({PARAGRAPHS_SQL})",
    "sentences": None,
    "pending_units": f"""
WITH u AS (SELECT sha256('v1|' || p) AS key, doc_id, i AS ordinal FROM ({PARAGRAPHS_SQL}))
SELECT key, doc_id, ordinal FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id, ordinal) AS r FROM u WHERE key NOT IN (SELECT key FROM u JOIN labels USING (doc_id))) WHERE r = 1""",
}
