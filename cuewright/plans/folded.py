"""Queries of the ordered folds and library functions that SQL cannot express; tests hold them against worked examples and round trips."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuewright.functions import captions, validation
from cuewright.functions import text as t
from cuewright.operators import documents, folds, paragraphs, templates, transcripts
from cuewright.plans.texts import turn_cues
from cuewright.session import table

#: A small lexicon for the checks; a user brings their own.
LEXICON = validation.Lexicon(common=frozenset("the of and is in a to this that we it for on with are as be".split()), retained=frozenset(["hence", "further"]), connectors=frozenset(["and", "is"]))


def page_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as templates and units, with their masked texts."""
    return templates.document_units(table(spark, sf_dir, "pages"))


def styled_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents with sizes and styles made of their lengths, ten to a page."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_idx", "text")).filter(F.trim("text") != "")
    n = F.length("text")
    size = F.when(n < 12, 18.0).when(n % 17 == 0, 9.0).otherwise(12.0)
    return lines.select("doc_id", "line_idx", "text", F.floor(F.col("line_idx") / 10).cast("int").alias("page"), size.alias("size"), (n % 13 == 0).alias("bold"), F.lit(False).alias("italic"), F.lit("left").alias("alignment"))


def page_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as paragraphs with notes."""
    return paragraphs.paragraphs(styled_lines(spark, sf_dir), "doc_id", "line_idx").drop("notes")


def styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles of the styles of each document."""
    return documents.font_roles(styled_lines(spark, sf_dir).withColumnRenamed("size", "font_size"), "doc_id", "line_idx")


def validations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items against the next one as their translation: the first check that fails."""
    items = table(spark, sf_dir, "benchmark").select("item_id", "text")
    others = items.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("target"))
    return items.join(others, "item_id", "left").select("item_id", validation.validate_column(LEXICON)(F.col("text"), F.col("target")).alias("code"))


def windows_of_speech(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as recordings, their sentences as segments: candidates for a reference."""
    words = F.split(F.regexp_replace("text", r"\s+", " "), r"(?<=[.!?]) ")
    parts = turn_cues(spark, sf_dir).select(F.concat_ws("/", "doc_id", "cue_idx").alias("doc_id"), F.posexplode(words).alias("cue_idx", "text")).filter("text <> ''")
    timed = parts.select("doc_id", "cue_idx", (F.col("cue_idx") * 2.5).alias("start_s"), (F.col("cue_idx") * 2.5 + 2.5).alias("finish_s"), "text", F.array_repeat(F.lit(0.9) + F.length("text") % 7 / 100.0, 5).alias("confidences"))
    return transcripts.reference_candidates(timed)


def transcript_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items against the next one as what was heard."""
    items = table(spark, sf_dir, "benchmark").select("item_id", "text")
    heard = items.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("heard"))
    s = transcripts.transcript_score(F.col("text"), F.col("heard"), F.array(F.lit(0.5), F.lit(0.9)), F.lit("en"), "en", 0.2)
    return items.join(heard, "item_id").select("item_id", s.alias("s")).select("item_id", "s.*")


def dubbing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as clips that are longer than their slots, spread over the gaps."""
    cues = turn_cues(spark, sf_dir)
    total = cues.groupBy("doc_id").agg(F.max("finish_s").alias("total_s"))
    return folds.scheduled(cues.withColumn("duration_s", (F.col("finish_s") - F.col("start_s")) * (1 + F.length("text") % 3) + 1.0).filter("finish_s > start_s").join(total, "doc_id"))


def joined_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines joined, texts packed, pieces chosen and captions cut."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.split("text", "\n").alias("lines"))
    lengths = F.transform("lines", lambda x: (F.length(x) % 90 / 10.0).cast("double"))
    return docs.select(
        "doc_id", F.length(folds.joined_lines(F.col("lines"))).alias("joined"), F.size(folds.packed(200)(F.col("text"))).alias("packs"), folds.chosen_pieces(lengths).alias("pieces"),
        F.length(captions.cut_column(120, album=True)(t.escaped(F.left("text", F.lit(400))))).alias("caption"),
    )


SQL = dict.fromkeys(("page_units", "page_paragraphs", "styles", "validations", "windows_of_speech", "transcript_scores", "dubbing", "joined_texts"))
