"""Queries of selections, orders, nested results and decision tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuewright.functions import media
from cuewright.operators import cues, lookups, state, windows
from cuewright.plans.records import LINES_SQL, document_lines
from cuewright.plans.texts import turn_cues
from cuewright.session import table


def cue_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of each recording between 30 and 150 seconds."""
    return cues.sliced(turn_cues(spark, sf_dir).select("doc_id", "cue_idx", "start_s", "finish_s"), 30.0, 150.0)


def top_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five longest documents of each language."""
    w = Window.partitionBy("lang").orderBy(F.col("n_chars").desc(), "doc_id")
    return table(spark, sf_dir, "documents").select("lang", "doc_id", "n_chars").withColumn("place", F.row_number().over(w)).filter("place <= 5")


def longest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest page of each language of the path, of several the first."""
    lang = F.regexp_extract("url", r"://[^/]+/([a-z]+)/", 1)
    pages = table(spark, sf_dir, "pages").select(lang.alias("lang"), "page_id", "html")
    return lookups.longest_of(pages, ["lang"], "html", "page_id").select("lang", "page_id", F.length("html").alias("n"))


def log_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 50 events."""
    return state.tail(table(spark, sf_dir, "events").select("event_id", "event_type"), 50, ["event_id"])


def first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each line of a source occurs first."""
    lines = document_lines(spark, sf_dir).select("source", F.md5("text").alias("line"), "doc_id", F.col("line_idx").cast("long").alias("line_idx"))
    return cues.first_seen(lines, ["source"], "line", ["doc_id", "line_idx"])


def speech_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences numbered through each source, by document and line."""
    lines = document_lines(spark, sf_dir).select("source", "doc_id", "line_idx")
    numbered = windows.batches(lines, ["doc_id", "line_idx"], 1, ["source"])
    return numbered.select("source", "doc_id", "line_idx", (F.col("batch") + 1).alias("job"))


def outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user turn with the answers that follow it, in order."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    tree = lookups.outlined(turns, ["conv_id"], "turn", F.col("role") == "user", F.concat_ws(":", "turn", "role"))
    return tree.select("conv_id", F.col("head").alias("chapter"), F.array_join("items", ",").alias("answers"))


def run_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases by repeats: a few dozen nations, three times each."""
    return lookups.matrix(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), 3)


def reply_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with the user turn that they reply to."""
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), (F.col("conv_id") * 1000 + F.col("turn") - 1).alias("reply_to"), "conv_id", "turn", "role")
    pairs = lookups.replies(turns, "reply_to", "id", F.col("role") == "assistant", F.col("role") == "user")
    return pairs.select("conv_id", "turn", "role", (F.col("asked") % 1000).alias("asked"))


def media_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names, types and speeds made from parts."""
    n, k = F.col("p_size") % 7, F.col("p_partkey") % 5
    extension = F.when(n == 0, ".PDF").when(n == 1, ".htm").when(n == 2, ".epub").when(n == 3, ".xyz").when(n == 4, ".Yaml").when(n == 5, ".txt").otherwise("")
    mime = F.when(k == 0, "text/plain").when(k == 1, "video/mp4").when(k == 2, "image/gif").when(k == 3, "application/x-yaml").otherwise("audio/ogg")
    name = F.when(F.col("p_partkey") % 11 == 0, "").otherwise(F.concat("p_name", extension))
    declared = F.when(F.col("p_partkey") % 2 == 0, "photo").otherwise("sticker")
    speed = F.col("p_size").cast("double") / 4
    return table(spark, sf_dir, "part").select(
        "p_partkey", media.format_of(name).alias("format"), media.document_kind(name, mime).alias("kind"), media.send_type(mime, declared).alias("sent_as"), media.album_item(mime, declared).alias("album"),
        F.size(media.tempo_chain(speed)).alias("tempo_steps"), F.aggregate(media.tempo_chain(speed), F.lit(1.0), lambda p, x: p * x).alias("tempo"),
    )


def audio_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose items all have the same flag and status."""
    return lookups.same_signature(table(spark, sf_dir, "lineitem"), ["l_orderkey"], ["l_returnflag", "l_linestatus"])


def page_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lists of pages as one, each page once, in order."""
    n, k = F.col("p_size"), (F.col("p_partkey") % 40).cast("int")
    union = F.array_union(F.sequence(n, n + 3), F.sequence(k, k + 5))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.array_sort(union), ",").alias("pages"))


SQL = {
    "cue_slice": """
WITH c AS (SELECT CAST(conv_id AS VARCHAR) AS doc_id, turn AS cue_idx, turn * 60.0::DOUBLE AS a, turn * 60.0::DOUBLE + length(text) / 10.0::DOUBLE AS b FROM conversations)
SELECT doc_id, cue_idx, least(greatest(a, 30.0::DOUBLE), 150.0::DOUBLE) - 30.0::DOUBLE AS start_s, least(greatest(b, 30.0::DOUBLE), 150.0::DOUBLE) - 30.0::DOUBLE AS finish_s FROM c WHERE b > 30 AND a < 150""",
    "top_per_group": "SELECT lang, doc_id, n_chars, CAST(place AS INTEGER) AS place FROM (SELECT lang, doc_id, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS place FROM documents) WHERE place <= 5",
    "longest_first": """
WITH p AS (SELECT regexp_extract(url, '://[^/]+/([a-z]+)/', 1) AS lang, page_id, CAST(length(html) AS INTEGER) AS n FROM pages)
SELECT lang, page_id, n FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, page_id) AS r FROM p) WHERE r = 1""",
    "log_tail": "SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 50",
    "first_seen": f"SELECT source, line, doc_id, line_idx FROM (SELECT source, md5(text) AS line, doc_id, line_idx, row_number() OVER (PARTITION BY source, md5(text) ORDER BY doc_id, line_idx) AS r FROM ({LINES_SQL})) WHERE r = 1",
    "speech_jobs": f"SELECT source, doc_id, line_idx, row_number() OVER (PARTITION BY source ORDER BY doc_id, line_idx) AS job FROM ({LINES_SQL})",
    "outline": """
WITH f AS (SELECT conv_id, turn, role, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn, role ROWS UNBOUNDED PRECEDING) AS chapter FROM conversations)
SELECT conv_id, chapter, coalesce(string_agg(turn || ':' || role, ',' ORDER BY turn, role) FILTER (role <> 'user'), '') AS answers FROM f WHERE chapter IS NOT NULL GROUP BY conv_id, chapter""",
    "run_matrix": "SELECT n_nationkey, n_name, CAST(unnest([1, 2, 3]) AS INTEGER) AS repeat FROM nation",
    "reply_pairs": "SELECT a.conv_id, a.turn, a.role, u.turn AS asked FROM conversations a JOIN conversations u ON u.conv_id = a.conv_id AND u.turn + 1 = a.turn AND u.role = 'user' WHERE a.role = 'assistant'",
    "media_kinds": """
WITH p AS (SELECT p_partkey, p_size % 7 AS n, p_partkey % 5 AS k, p_partkey % 11 = 0 AS unnamed, p_size / 4.0::DOUBLE AS speed FROM part),
f AS (SELECT *, CASE WHEN unnamed THEN NULL ELSE CASE n WHEN 0 THEN 'pdf' WHEN 1 THEN 'html' WHEN 2 THEN 'epub' WHEN 4 THEN 'yaml' WHEN 5 THEN 'txt' END END AS format FROM p)
SELECT p_partkey, format, CASE WHEN format IN ('pdf', 'epub', 'yaml', 'txt') THEN format WHEN k = 3 THEN 'yaml' WHEN k = 0 AND unnamed THEN 'txt' END AS kind,
  CASE k WHEN 1 THEN 'video' WHEN 2 THEN 'photo' WHEN 4 THEN 'audio' ELSE CASE WHEN p_partkey % 2 = 0 THEN 'photo' ELSE 'document' END END AS sent_as, k IN (1, 2) OR k IN (0, 3) AND p_partkey % 2 = 0 AS album,
  CAST(CASE WHEN speed > 8 THEN 4 WHEN speed > 4 THEN 3 WHEN speed > 2 THEN 2 WHEN speed = 1 THEN 0 ELSE 1 END AS INTEGER) AS tempo_steps, speed AS tempo FROM f""",
    "audio_signature": "SELECT l_orderkey, count(DISTINCT l_returnflag || '|' || l_linestatus) = 1 AS same FROM lineitem GROUP BY l_orderkey",
    "page_union": "SELECT p_partkey, array_to_string(list_sort(list_distinct(list_concat(range(p_size, p_size + 4), range(p_partkey % 40, p_partkey % 40 + 6)))), ',') AS pages FROM part",
}
