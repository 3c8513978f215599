"""Queries of the text and time functions, and of the folds and alignments that SQL cannot express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuewright.functions import similarity
from cuewright.functions import text as t
from cuewright.functions import time as clock
from cuewright.operators import alignment, folds
from cuewright.plans.records import document_lines
from cuewright.session import table
from cuewright.sources import html, subtitles


def text_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F4, F5, F11, F18, F40, F42 on whole documents."""
    text = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.md5(t.norm_ws(text)).alias("normal"),
        F.size(t.alphabetic_words(text)).alias("n_words"),
        t.ends_sentence(text).alias("ends"),
        t.speakable(text).alias("speakable"),
        F.md5(t.redacted(text)).alias("redacted"),
        F.size(t.line_breaks(text)).alias("n_breaks"),
        t.packed_entities(text).alias("n_entities"),
        F.md5(t.without_markers(text)).alias("unmarked"),
        F.size(t.markers(text)).alias("n_markers"),
        F.md5(t.unlabelled(F.concat(F.lit("Translated text : "), text))).alias("unlabelled"),
        F.md5(t.html_escaped(text)).alias("html"),
    )


def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F22, K12 on names."""
    return table(spark, sf_dir, "customer").select("c_custkey", t.slug(F.col("c_name")).alias("slug"), t.safe_name(F.concat_ws("/", "c_name", "c_mktsegment"), 20).alias("file"))


def timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seconds written as a timestamp and read again."""
    millis = F.col("event_id") * 86413 + F.floor(F.col("value")).cast("long")
    stamped = table(spark, sf_dir, "events").select("event_id", clock.format_timestamp(millis / F.lit(1000.0)).alias("stamp"))
    return stamped.withColumn("seconds", clock.parse_timestamp(F.col("stamp")))


def page_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Range lists made of sizes, expanded."""
    listed = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(",", F.col("p_size").cast("string"), F.concat_ws("-", F.col("p_partkey") % 40, F.col("p_partkey") % 40 + 5), F.lit("3-5")).alias("ranges"))
    return listed.select("p_partkey", F.array_join(clock.range_values(clock.range_list(F.col("ranges"))), ",").alias("pages"))


def line_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P2, P12, F13 on lines: how many of a source are noise, are speakable, and differ in normal form."""
    from cuewright.operators.aggregates import boundary_text

    lines = document_lines(spark, sf_dir)
    return lines.groupBy("source").agg(F.count("*").alias("lines"), F.count_if(t.noise(F.col("text"))).alias("noise"), F.count_if(t.speakable(F.col("text"))).alias("speakable"), F.count_distinct(boundary_text(F.col("text"))).alias("forms"))


def turn_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as recordings: a cue per turn, a second per ten characters."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("doc_id"), F.col("turn").alias("cue_idx"), "role", "text")
    start = F.col("cue_idx") * 60.0
    return turns.select("doc_id", "cue_idx", start.alias("start_s"), (start + F.length("text") / 10.0).alias("finish_s"), "text", F.col("role").alias("speaker_id"))


def merge_adjacent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W16 over W19: turns cut into cues, then merged again where they fit."""
    return folds.per_document(turn_cues(spark, sf_dir), lambda cues: folds.merge_adjacent([p for c in cues for p in folds.split_long(c, 40)]))


def sentence_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of turns as sentences."""

    def fold(cues: list[folds.Entry]) -> list[folds.Entry]:
        words = []
        for c in cues:
            parts = c.text.split()
            step = (c.finish - c.start) / max(1, len(parts))
            words += [folds.Entry(c.start + i * step, c.start + (i + 1) * step, w, c.speaker) for i, w in enumerate(parts)]
        return folds.sentences(words)

    return folds.per_document(turn_cues(spark, sf_dir), fold)


def semantic_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings against a copy that is shifted, shortened and reworded in places."""
    before = turn_cues(spark, sf_dir)
    shift = F.when(F.col("cue_idx") % 4 == 1, 0.5).otherwise(0.0)
    after = before.filter("cue_idx % 7 <> 6").select("doc_id", "cue_idx", (F.col("start_s") + shift).alias("start_s"), (F.col("finish_s") + shift).alias("finish_s"), F.when(F.col("cue_idx") % 5 == 2, F.upper("text")).otherwise(F.col("text")).alias("text"))
    return alignment.semantic_diff(before, after, 0.01)


def wer_lcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """benchmark items against the next one."""
    words = table(spark, sf_dir, "benchmark").select("item_id", t.alphabetic_words(F.col("text")).alias("words"))
    following = words.select((F.col("item_id") - 1).alias("item_id"), F.col("words").alias("others"))
    return words.join(following, "item_id").select("item_id", similarity.match_share_udf("words", "others").alias("match"), similarity.error_rate_udf("words", "others").alias("wer"))


def html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S14."""
    return html.blocks(table(spark, sf_dir, "pages"))


def srt_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings written as SRT and read again."""
    return subtitles.cues(subtitles.rendered(turn_cues(spark, sf_dir)))


SQL = {
    "text_scalars": r"""
SELECT doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS normal, CAST(len(regexp_extract_all(lower(text), '\p{L}+')) AS INTEGER) AS n_words,
  regexp_matches(text, '[.!?…。！？]["''”’)\]]*\s*$') AS ends, regexp_matches(text, '[\p{L}\p{N}]') AS speakable,
  md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?i)/cookies\b[^\r\n]*', '/cookies [REDACTED]', 'g'), 'bot[0-9]+:[A-Za-z0-9_-]+', 'bot[REDACTED]', 'g'), '(?i)\b(authorization|cookie|set-cookie)\s*[:=]\s*[^\r\n]+', '\1: [REDACTED]', 'g'), '(https?://[^\s?]+)\?[^\s]+', '\1?[REDACTED]', 'g')) AS redacted,
  md5(regexp_replace(regexp_replace(text, '([\p{L})\].,;:"])[0-9]{1,3}(\s*:)', '\1\2', 'g'), '([\p{L})\].,;:"])[0-9]{1,3}(\s|$)', '\1\2', 'g')) AS unmarked,
  CAST(len(regexp_extract_all(regexp_replace(text, '([\p{L})\].,;:"])[0-9]{1,3}(\s*:)', '\1\2', 'g'), '[\p{L})\].,;:"][0-9]{1,3}(?:\s|$)')) AS INTEGER) AS n_markers,
  md5(text) AS unlabelled, md5(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#39;')) AS html,
  CAST(len(regexp_extract_all(text, '\r\n|\r|\n')) AS INTEGER) AS n_breaks, CAST(len(regexp_extract_all(text, '&(#[0-9]+|#x[0-9a-fA-F]+|[A-Za-z]+);')) AS INTEGER) AS n_entities FROM documents""",
    "slugs": """SELECT c_custkey, regexp_replace(regexp_replace(lower(c_name), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug, left(trim(regexp_replace(replace(c_name || '/' || c_mktsegment, '/', ', '), '["'']', '', 'g')), 20) AS file FROM customer""",
    "timestamps": """
WITH m AS (SELECT event_id, event_id * 86413 + CAST(floor(value) AS BIGINT) AS ms FROM events)
SELECT event_id, CASE WHEN ms >= 360000000 THEN CAST(ms // 3600000 AS VARCHAR) ELSE lpad(CAST(ms // 3600000 AS VARCHAR), 2, '0') END || ':' || lpad(CAST(ms // 60000 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(ms // 1000 % 60 AS VARCHAR), 2, '0') || ',' || lpad(CAST(ms % 1000 AS VARCHAR), 3, '0') AS stamp, ms / 1000.0::DOUBLE AS seconds FROM m""",
    "page_ranges": """
WITH p AS (SELECT p_partkey, p_size AS n FROM part UNION SELECT p_partkey, unnest(range(p_partkey % 40, p_partkey % 40 + 6)) FROM part UNION SELECT p_partkey, unnest([3, 4, 5]) FROM part)
SELECT p_partkey, string_agg(CAST(n AS VARCHAR), ',' ORDER BY n) AS pages FROM p GROUP BY p_partkey""",
    "line_digits": r"""
WITH l AS (SELECT source, parts[i] AS text FROM (SELECT source, string_split(text, chr(10)) AS parts, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents) WHERE trim(parts[i]) <> '')
SELECT source, count(*) AS lines, count(*) FILTER (regexp_matches(text, '^\s*[0-9](?:\s*\.\s*[0-9]){3,}\.?\s*$')) AS noise, count(*) FILTER (regexp_matches(text, '[\p{L}\p{N}]')) AS speakable,
  count(DISTINCT regexp_replace(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), '[0-9]+', '#', 'g')) AS forms FROM l GROUP BY source""",
    "merge_adjacent": None,
    "sentence_cues": None,
    "semantic_diff": None,
    "wer_lcs": None,
    "html_blocks": None,
    "srt_round_trip": None,
}
