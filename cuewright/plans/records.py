"""Queries of the joins, aggregations and scores on the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuewright.functions import text as text_functions
from cuewright.operators import aggregates, joins, quality
from cuewright.session import table


def measured(docs: DataFrame) -> DataFrame:
    """Documents as recordings: stand-ins for the acoustic metrics, made of their words and characters."""
    n = F.size(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), 0)).cast("long")
    m = F.col("n_words")
    return docs.select("doc_id", n.alias("n_words"), "n_chars", aggregates.trigram_ratio(F.col("text")).alias("entropy")).select(
        "doc_id", "entropy",
        (m % 41 - 2).cast("double").alias("estimated_snr_db"), (F.lit(-60) + m % 47).cast("double").alias("estimated_noise_floor_db"),
        ((F.col("n_chars") % 16) / F.lit(100.0)).alias("zero_crossing_rate"), (F.lit(8) + F.col("n_chars") % 10).cast("double").alias("bit_depth"),
        ((m % 40) / F.lit(100.0)).alias("silence_ratio"), (F.lit(-40) + m % 37).cast("double").alias("integrated_lufs"), (m % 19).cast("double").alias("loudness_range_lu"),
        ((m % 17) / F.lit(-4.0)).alias("true_peak_db"), ((F.col("n_chars") % 9) / F.lit(-4.0)).alias("peak_db"), (F.lit(-45) + m % 41).cast("double").alias("rms_db"),
        (F.lit(-50) + m % 23).cast("double").alias("leading_rms_db"), (F.lit(-50) + m % 29).cast("double").alias("trailing_rms_db"),
    )


METRICS = ("estimated_snr_db", "estimated_noise_floor_db", "entropy", "zero_crossing_rate", "bit_depth", "silence_ratio", "integrated_lufs", "loudness_range_lu", "true_peak_db", "peak_db", "rms_db", "leading_rms_db", "trailing_rms_db")


def quality_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship (A8, A9, A18, F65, J6, T1, W11): documents without a label are pending; score, grade and rank them.

    The parts are not rounded here, since engines round halves of doubles differently.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    rows = measured(joins.pending(docs, table(spark, sf_dir, "labels"), ["doc_id"]))
    parts = quality.score_components({m: F.col(m) for m in METRICS}, digits=None)
    scored = rows.withColumn("parts", parts).withColumn("score", quality.reference_score(F.col("parts"), digits=None))
    signal = quality.signal_score(F.col("entropy"), F.col("zero_crossing_rate"), F.col("rms_db"))
    scored = scored.select("doc_id", "entropy", F.col("parts.estimated_snr").alias("snr_points"), F.col("parts.loudness").alias("loudness_points"), signal.alias("signal_score"), "score", quality.grade(F.col("score")).alias("grade"))
    return quality.ranked(scored, "score", "doc_id")


def nearest_rank_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2 by event type."""
    return table(spark, sf_dir, "events").groupBy("event_type").agg(*(aggregates.nearest_rank(p, "value").alias(f"p{int(p * 100)}") for p in (0.1, 0.5, 0.9)), F.min("value").alias("lowest"), F.max("value").alias("highest"))


def floor_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3 by user: the values of one user are few."""
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_list("value").alias("v")).select("user_id", aggregates.floor_rank(F.col("v"), 0.1).alias("p10"))


def timing_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: items as clips; line number 4 is natural speed and each step from it halves or doubles. All sums are of whole numbers, so the figures are exact."""
    speed = F.pow(F.lit(2.0), F.col("l_linenumber") - 4)
    clips = table(spark, sf_dir, "lineitem").select("l_returnflag", speed.alias("speed"), F.col("l_quantity").alias("start_error"), F.lit(0.0).alias("end_error"))
    scored = aggregates.timing_score(clips, ["l_returnflag"])
    return scored.select("l_returnflag", "clips", "deviation_index", "p90_deviation", "slot_rms_ms", "min_speed", "p10_speed", "p50_speed", "p90_speed", "max_speed")


def unique_trigram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A18."""
    return table(spark, sf_dir, "documents").select("doc_id", aggregates.trigram_ratio(F.col("text")).alias("ratio"))


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources as books, documents as pages, non-blank lines as lines."""
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", F.posexplode(F.split("text", "\n")).alias("line_idx", "text"))
    return docs.filter(F.trim("text") != "")


def header_footer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that stay when running headers and footers go, by document."""
    kept = aggregates.without_headers(document_lines(spark, sf_dir), "source", "doc_id")
    return kept.groupBy("source", "doc_id").agg(F.count("*").alias("lines"), F.sum("line_idx").alias("sum_idx"))


def beginnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents by language as books, each line its first character: so that some texts do recur at the ends of pages."""
    docs = table(spark, sf_dir, "documents").select("lang", "doc_id", F.posexplode(F.split("text", "\n")).alias("line_idx", "text"))
    return docs.filter(F.trim("text") != "").withColumn("text", F.left(F.trim("text"), F.lit(1)))


def page_boundaries_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that recur at page boundaries, and how many lines of a book are left without them."""
    lines = beginnings(spark, sf_dir).filter("lang IS NOT NULL")
    found = aggregates.repeated_boundaries(lines, "lang", "doc_id")
    left = aggregates.without_boundaries(lines, "lang", "doc_id").groupBy("lang").agg(F.count("*").alias("left"))
    return found.join(left, "lang")


def mode_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent size of a brand, of several the first seen."""
    return aggregates.mode_first(table(spark, sf_dir, "part"), ["p_brand"], "p_size", "p_partkey")


def chapter_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the first of their items."""
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey", "l_suppkey", F.unix_date(F.col("l_shipdate").cast("date")).alias("day"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return joins.first_match(orders, items, ["o_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "day"])


def pending_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without a label."""
    return joins.pending(table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels"), ["doc_id"])


def labelled_semijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a label."""
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")


def speaker_attrib(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events (60 * value seconds long) as words, six-hour spans of a user's first event of each span as segments."""
    seconds = F.unix_micros(F.col("ts").cast("timestamp")).cast("double") / 1_000_000
    words = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", seconds.alias("start_s"), (seconds + F.floor(F.col("value")) * 60).alias("finish_s"))
    spans = words.groupBy("user_id", F.floor(F.col("start_s") / 21600).alias("span")).agg(F.min_by("event_type", "event_id").alias("speaker_id"))
    segments = spans.filter("span % 3 <> 0").select("user_id", F.concat_ws("/", "speaker_id", "span").alias("speaker_id"), (F.col("span") * 21600.0).alias("start_s"), (F.col("span") * 21600.0 + 18000.0).alias("finish_s"))
    words = words.join(segments.select("user_id").distinct(), "user_id", "left_semi")
    return joins.max_overlap(words.select("user_id", "event_id", "start_s", "finish_s"), segments, ["user_id"], "event_id", width=21600.0)


def age_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by age at a fixed date."""
    age = F.datediff(F.lit("2002-01-01").cast("date"), F.col("o_orderdate").cast("date"))
    return table(spark, sf_dir, "orders").select("o_orderkey", age.alias("age"), quality.tier(age, [(30, "new"), (60, "recent"), (90, "old"), (None, "archive")]).alias("tier"))


def diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as recordings: codes of the issues in order, observed value of the first, acceptance, and whether the signal alone would do."""
    found = quality.diagnosis(measured(table(spark, sf_dir, "documents")), {m: m for m in METRICS})
    return found.select("doc_id", F.array_join(F.transform("issues", lambda i: F.concat_ws("/", i["severity"], i["code"])), ",").alias("codes"), F.get("issues", F.lit(0))["observed"].alias("observed"), "accepted", "signal_ok")


def uniq_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of each host."""
    pages = table(spark, sf_dir, "pages").select(text_functions.url_host(F.col("url")).alias("host"), "page_id", "url")
    return aggregates.first_of(pages, ["host"], ["page_id"])


def missing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers that a source lacks between its first and its last document."""
    ids = table(spark, sf_dir, "documents").groupBy("source").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    docs = table(spark, sf_dir, "documents").select("source", "doc_id")
    every = ids.select("source", F.explode(F.sequence("low", "high")).alias("doc_id"))
    return every.join(docs, ["source", "doc_id"], "left_anti")


def url_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F21."""
    return table(spark, sf_dir, "pages").select("page_id", text_functions.url_display(F.col("url")).alias("display"), text_functions.url_host(F.col("url")).alias("host"))


def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field of a JSON column by type of event."""
    k = F.from_json("props", "k long")["k"]
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("sum_k"), F.count_distinct(k).alias("distinct_k"))


def unit_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as content-addressed units; the first registration wins."""
    lines = document_lines(spark, sf_dir).select(F.sha2(F.concat_ws("|", F.lit("v1"), F.col("text")), 256).alias("key"), "doc_id", F.col("line_idx").cast("long").alias("line_idx"))
    return aggregates.first_of(lines, ["key"], ["doc_id", "line_idx"])


def cosine_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors in thousandths against the sum of their label, as whole numbers so that every order of adding agrees."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: F.floor(x.cast("double") * 1000).cast("long")).alias("v"))
    sums = vectors.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.sum("x").alias("s"))
    each = vectors.select("vec_id", "label", F.posexplode("v").alias("i", "x")).join(joins.small(sums), ["label", "i"])
    return each.groupBy("vec_id").agg(F.sum(F.col("x") * F.col("s")).alias("dot"), F.sum(F.col("x") * F.col("x")).alias("norm2"), F.sum(F.col("s") * F.col("s")).alias("centroid_norm2"))


def centroid_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of every vector, in thousandths, to the mean of its label, in millionths (so that the order of adding does not show)."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: F.floor(x.cast("double") * 1000).cast("double")).alias("v"))
    mean = aggregates.centroids(vectors, "label", "v")
    return vectors.join(joins.small(mean), "label").select("vec_id", F.floor(aggregates.cosine(F.col("v"), F.col("centroid")) * 1_000_000 + 0.5).cast("long").alias("millionths"))


def diff_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10: conversations against a copy without every fifth turn and with assistants renamed."""
    before = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    after = before.filter("(conv_id + turn) % 5 <> 0").withColumn("role", F.when((F.col("role") == "assistant") & (F.col("turn") % 3 == 1), "model").otherwise(F.col("role")))
    pairs = before.withColumnRenamed("role", "old").join(after.withColumnRenamed("role", "new"), ["conv_id", "turn"], "full_outer")
    kind = F.when(F.col("new").isNull(), "removed").when(F.col("old").isNull(), "added").when(F.col("old") != F.col("new"), "text_changed").otherwise("same")
    return pairs.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.max("turn").alias("last_turn"))


def word_multiset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How words of benchmark items exceed those of the next item."""
    words = table(spark, sf_dir, "benchmark").select("item_id", text_functions.alphabetic_words(F.col("text")).alias("words"))
    following = words.select((F.col("item_id") - 1).alias("item_id"), F.col("words").alias("others"))
    return words.join(following, "item_id").select("item_id", F.array_join(text_functions.multiset_diff(F.col("words"), F.col("others")), " ").alias("extra"))


def conditional_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit of the labels."""
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("toxic") == 1).alias("toxic"), F.count_if(F.col("quality") == 1).alias("good"), F.sum("n_chars").alias("chars"), aggregates.share_of(F.col("quality") == 1).alias("good_pct"))


def weighted_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether returned items hold half of a supplier's quantity."""
    return aggregates.majority(table(spark, sf_dir, "lineitem"), ["l_suppkey"], F.col("l_returnflag") == "R", F.col("l_quantity").cast("long"))


def union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two catalogues, one after the other."""
    one = table(spark, sf_dir, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_name").alias("title"))
    return one.unionByName(table(spark, sf_dir, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("title")))


WORDS_SQL = r"list_filter(regexp_split_to_array({0}, '\s+'), lambda w: w <> '')"
LINES_SQL = "SELECT source, doc_id, i - 1 AS line_idx, parts[i] AS text FROM (SELECT source, doc_id, string_split(text, chr(10)) AS parts, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents) WHERE trim(parts[i]) <> ''"
TRIGRAM_SQL = r"""
SELECT doc_id, n_chars, CASE WHEN len(w) >= 3 THEN CAST(len(list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' ')))) AS DOUBLE) / (len(w) - 2) ELSE 0.0 END AS ratio, len(w) AS m
FROM (SELECT doc_id, n_chars, regexp_extract_all(lower(text), '\p{L}+') AS w FROM documents)"""
MEASURED_SQL = f"""
SELECT doc_id, ratio AS entropy, (m % 41 - 2)::DOUBLE AS snr, (-60 + m % 47)::DOUBLE AS floor, (n_chars % 16) / 100.0::DOUBLE AS zcr, (8 + n_chars % 10)::DOUBLE AS depth, (m % 40) / 100.0::DOUBLE AS silence, (-40 + m % 37)::DOUBLE AS lufs,
  (m % 19)::DOUBLE AS lra, (m % 17) / -4.0::DOUBLE AS tp, (n_chars % 9) / -4.0::DOUBLE AS peak, (-45 + m % 41)::DOUBLE AS rms, (-50 + m % 23)::DOUBLE AS lead, (-50 + m % 29)::DOUBLE AS trail FROM ({TRIGRAM_SQL})"""
UP = "greatest(0.0::DOUBLE, least(1.0::DOUBLE, ({0} - ({1}::DOUBLE)) / (({2}::DOUBLE) - ({1}::DOUBLE)))) * {3}.0::DOUBLE"
HOST_SQL = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1))"

SQL = {
    "quality_rank": f"""
WITH m AS (SELECT * FROM ({MEASURED_SQL}) d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)),
p AS (SELECT *, {UP.format("snr", 8, 30, 30)} AS p1, {UP.format("floor", -20, -50, 20)} AS p2, {UP.format("entropy", 0.55, 0.9, 10)} AS p3, {UP.format("zcr", 0.15, 0.02, 5)} AS p4, {UP.format("depth", 10, 16, 5)} AS p5,
  {UP.format("silence", 0.35, 0.02, 10)} AS p6, greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1.0::DOUBLE - abs(lufs + 18.0::DOUBLE) / 15.0::DOUBLE)) * 10.0::DOUBLE AS p7, {UP.format("lra", 15, 4, 5)} AS p8, {UP.format("tp", -0.1, -3, 5)} AS p9 FROM m),
s AS (SELECT *, p1 + p2 + p3 + p4 + p5 + p6 + p7 + p8 + p9 AS score FROM p)
SELECT doc_id, entropy, p1 AS snr_points, p7 AS loudness_points, entropy - 2 * zcr - abs(rms + 20) / 20 AS signal_score, score, CASE WHEN score >= 80 THEN 'excellent' WHEN score >= 65 THEN 'good' WHEN score >= 50 THEN 'fair' ELSE 'poor' END AS grade, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM s""",
    "nearest_rank_pct": "SELECT event_type, quantile_disc(value, 0.1) AS p10, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.9) AS p90, min(value) AS lowest, max(value) AS highest FROM events GROUP BY event_type",
    "floor_pct": "SELECT user_id, v[least(CAST(floor(len(v) * 0.1::DOUBLE) AS BIGINT), len(v) - 1) + 1] AS p10 FROM (SELECT user_id, list(value ORDER BY value) AS v FROM events GROUP BY user_id)",
    "timing_score": """
WITH c AS (SELECT l_returnflag, power(2.0::DOUBLE, l_linenumber - 4) AS speed, CAST(abs(l_linenumber - 4) AS BIGINT) AS tempo, CAST(l_quantity AS BIGINT) AS e FROM lineitem)
SELECT l_returnflag, count(*) AS clips, sqrt(sum(tempo * tempo)::DOUBLE / count(*)) * 100 AS deviation_index, quantile_disc(tempo, 0.9)::DOUBLE * 100 AS p90_deviation, sqrt(sum(e * e)::DOUBLE / (2 * count(*))) * 1000 AS slot_rms_ms,
  min(speed) AS min_speed, quantile_disc(speed, 0.1) AS p10_speed, quantile_disc(speed, 0.5) AS p50_speed, quantile_disc(speed, 0.9) AS p90_speed, max(speed) AS max_speed FROM c GROUP BY l_returnflag""",
    "unique_trigram": f"SELECT doc_id, ratio FROM ({TRIGRAM_SQL})",
    "header_footer": rf"""
WITH l AS (SELECT *, regexp_replace(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), '[0-9]+', '#', 'g') AS k FROM ({LINES_SQL})),
e AS (SELECT source, doc_id, arg_min(k, line_idx) AS head, arg_max(k, line_idx) AS foot FROM l GROUP BY source, doc_id),
b AS (SELECT source, unnest([head, foot]) AS k FROM e), c AS (SELECT source, k, count(*) AS n FROM b GROUP BY source, k),
p AS (SELECT source, count(DISTINCT doc_id) AS pages FROM l GROUP BY source),
h AS (SELECT source, k FROM c JOIN p USING (source) WHERE n >= greatest(ceil(pages * 3 / 10.0), 3))
SELECT source, doc_id, count(*) AS lines, CAST(sum(line_idx) AS BIGINT) AS sum_idx FROM l WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.source = l.source AND h.k = l.k) GROUP BY source, doc_id""",
    "page_boundaries_exact": r"""
WITH r AS (SELECT lang, doc_id, i - 1 AS line_idx, left(trim(parts[i]), 1) AS text FROM (SELECT lang, doc_id, string_split(text, chr(10)) AS parts, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE lang IS NOT NULL) WHERE trim(parts[i]) <> ''),
l AS (SELECT *, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS k, line_idx = min(line_idx) OVER w OR line_idx = max(line_idx) OVER w AS edge FROM r WINDOW w AS (PARTITION BY lang, doc_id)),
b AS (SELECT DISTINCT lang, doc_id, k FROM l WHERE edge), c AS (SELECT lang, k AS boundary, count(*) AS n FROM b GROUP BY lang, k),
p AS (SELECT lang, count(DISTINCT doc_id) AS pages FROM l GROUP BY lang),
x AS (SELECT lang, boundary, n FROM c JOIN p USING (lang) WHERE pages >= 3 AND n >= greatest(ceil(pages * 3 / 10.0), 3)),
d AS (SELECT lang, doc_id, regexp_replace(k, '[0-9]+', '#', 'g') AS k FROM b), y AS (SELECT lang, k, count(DISTINCT doc_id) AS n FROM d GROUP BY lang, k), z AS (SELECT lang, k FROM y JOIN p USING (lang) WHERE pages >= 3 AND n >= greatest(ceil(pages * 3 / 10.0), 3)),
q AS (SELECT lang, count(*) AS "left" FROM l WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.lang = l.lang AND x.boundary = l.k) AND NOT (edge AND EXISTS (SELECT 1 FROM z WHERE z.lang = l.lang AND z.k = regexp_replace(l.k, '[0-9]+', '#', 'g'))) GROUP BY lang)
SELECT x.lang, boundary, n, q."left" FROM x JOIN q USING (lang)""",
    "mode_body": """
WITH t AS (SELECT p_brand, p_size, count(*) AS n, min(p_partkey) AS first FROM part GROUP BY p_brand, p_size)
SELECT p_brand, p_size, n FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, first) AS r FROM t) WHERE r = 1""",
    "chapter_map": """
WITH f AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS INTEGER) AS day FROM lineitem),
g AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, day) AS r FROM f) WHERE r = 1)
SELECT o_orderkey, o_custkey, l_linenumber, l_partkey, l_suppkey, day FROM orders JOIN g ON o_orderkey = l_orderkey""",
    "pending_antijoin": "SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)",
    "labelled_semijoin": "SELECT doc_id, lang FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)",
    "speaker_attrib": """
WITH w AS (SELECT user_id, event_id, event_type, epoch_us(ts)::DOUBLE / 1000000 AS ws, epoch_us(ts)::DOUBLE / 1000000 + floor(value) * 60 AS wf FROM events),
s AS (SELECT user_id, CAST(floor(ws / 21600) AS BIGINT) AS span, arg_min(event_type, event_id) AS kind FROM w GROUP BY 1, 2),
g AS (SELECT user_id, kind || '/' || span AS speaker_id, span * 21600.0::DOUBLE AS ss, span * 21600.0::DOUBLE + 18000.0 AS sf FROM s WHERE span % 3 <> 0),
j AS (SELECT w.user_id, event_id, speaker_id, greatest(0, least(wf, sf) - greatest(ws, ss)) AS o, greatest(0, ss - wf, ws - sf) AS d, ss, sf FROM w JOIN g ON w.user_id = g.user_id)
SELECT user_id, event_id, speaker_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_id ORDER BY o DESC, d, ss DESC, sf) AS r FROM j) WHERE r = 1""",
    "age_tier": "SELECT o_orderkey, age, CASE WHEN age <= 30 THEN 'new' WHEN age <= 60 THEN 'recent' WHEN age <= 90 THEN 'old' ELSE 'archive' END AS tier FROM (SELECT o_orderkey, CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '2002-01-01') AS INTEGER) AS age FROM orders)",
    "diagnosis": f"""
WITH i AS (SELECT *, list_filter([
  CASE WHEN peak > -1 THEN {{'c': 'error/peak_too_high', 'o': peak}} END, CASE WHEN rms < -35 OR rms > -10 THEN {{'c': 'error/rms_out_of_range', 'o': rms}} END, CASE WHEN entropy < 0.6::DOUBLE THEN {{'c': 'error/low_entropy', 'o': entropy}} END,
  CASE WHEN zcr > 0.12::DOUBLE THEN {{'c': 'error/excessive_zero_crossing', 'o': zcr}} END, CASE WHEN depth < 14 THEN {{'c': 'error/low_bit_depth', 'o': depth}} END, CASE WHEN lufs < -22 OR lufs > -14 THEN {{'c': 'error/integrated_loudness_out_of_range', 'o': lufs}} END,
  CASE WHEN lra > 6 THEN {{'c': 'error/excessive_loudness_range', 'o': lra}} END, CASE WHEN tp > -1.5::DOUBLE THEN {{'c': 'error/true_peak_too_high', 'o': tp}} END, CASE WHEN silence > 0.1::DOUBLE THEN {{'c': 'error/excessive_silence', 'o': silence}} END,
  CASE WHEN floor > -30 THEN {{'c': 'error/background_noise', 'o': floor}} END, CASE WHEN snr < 12 THEN {{'c': 'error/low_estimated_snr', 'o': snr}} END, CASE WHEN lead > -35 THEN {{'c': 'warning/active_leading_edge', 'o': lead}} END,
  CASE WHEN trail > -35 THEN {{'c': 'warning/active_trailing_edge', 'o': trail}} END], lambda x: x IS NOT NULL) AS issues FROM ({MEASURED_SQL}))
SELECT doc_id, array_to_string(list_transform(issues, lambda x: x.c), ',') AS codes, issues[1].o AS observed, len(list_filter(issues, lambda x: starts_with(x.c, 'error'))) = 0 AS accepted,
  peak <= -1 AND rms BETWEEN -35 AND -10 AND entropy >= 0.6::DOUBLE AND zcr <= 0.12::DOUBLE AND depth >= 14 AS signal_ok FROM i""",
    "uniq_first": f"SELECT {HOST_SQL} AS host, min(page_id) AS page_id, arg_min(url, page_id) AS url FROM pages GROUP BY 1",
    "missing_pages": """
WITH r AS (SELECT source, unnest(range(min(doc_id), max(doc_id) + 1)) AS doc_id FROM documents GROUP BY source)
SELECT source, doc_id FROM r WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.source = r.source AND d.doc_id = r.doc_id)""",
    "url_display": rf"""
WITH n AS (SELECT page_id, url, CASE WHEN regexp_matches(trim(url), '(?i)^https?://') THEN trim(url) ELSE 'https://' || trim(url) END AS whole FROM pages)
SELECT page_id, CASE WHEN regexp_matches(whole, '(?i)^https?://[^/?#\s]+') THEN regexp_replace(regexp_replace(whole, '(?i)^https?://', ''), '(?i)^www\.', '') END AS display, {HOST_SQL} AS host FROM n""",
    "json_props": "SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS sum_k, count(DISTINCT CAST(json_extract(props, '$.k') AS BIGINT)) AS distinct_k FROM events GROUP BY event_type",
    "unit_registry": f"SELECT key, doc_id, line_idx FROM (SELECT sha256('v1|' || text) AS key, doc_id, line_idx, row_number() OVER (PARTITION BY sha256('v1|' || text) ORDER BY doc_id, line_idx) AS r FROM ({LINES_SQL})) WHERE r = 1",
    "cosine_centroid": """
WITH v AS (SELECT vec_id, label, i, CAST(floor(CAST(embedding[i] AS DOUBLE) * 1000) AS BIGINT) AS x FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)),
s AS (SELECT label, i, sum(x) AS s FROM v GROUP BY label, i)
SELECT vec_id, CAST(sum(x * s) AS BIGINT) AS dot, CAST(sum(x * x) AS BIGINT) AS norm2, CAST(sum(s * s) AS BIGINT) AS centroid_norm2 FROM v JOIN s USING (label, i) GROUP BY vec_id""",
    "centroid_cosine": """
WITH v AS (SELECT vec_id, label, i, floor(CAST(embedding[i] AS DOUBLE) * 1000) AS x FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)),
m AS (SELECT label, i, avg(x) AS m FROM v GROUP BY label, i)
SELECT vec_id, CAST(floor(sum(x * m) / (sqrt(sum(x * x)) * sqrt(sum(m * m))) * 1000000 + 0.5) AS BIGINT) AS millionths FROM v JOIN m USING (label, i) GROUP BY vec_id""",
    "diff_summary": """
WITH a AS (SELECT conv_id, turn, CASE WHEN role = 'assistant' AND turn % 3 = 1 THEN 'model' ELSE role END AS new FROM conversations WHERE (conv_id + turn) % 5 <> 0),
p AS (SELECT turn, CASE WHEN new IS NULL THEN 'removed' WHEN role IS NULL THEN 'added' WHEN role <> new THEN 'text_changed' ELSE 'same' END AS kind FROM conversations FULL JOIN a USING (conv_id, turn))
SELECT kind, count(*) AS n, max(turn) AS last_turn FROM p GROUP BY kind""",
    "word_multiset": r"""
WITH w AS (SELECT item_id, regexp_extract_all(lower(text), '\p{L}+') AS words FROM benchmark),
c AS (SELECT item_id, word, count(*) AS n FROM (SELECT item_id, unnest(words) AS word FROM w) GROUP BY ALL),
d AS (SELECT a.item_id, a.word, a.n - coalesce(b.n, 0) AS more FROM c a LEFT JOIN c b ON b.item_id = a.item_id + 1 AND b.word = a.word),
x AS (SELECT item_id, string_agg(trim(repeat(word || ' ', CAST(more AS BIGINT))), ' ' ORDER BY word) AS extra FROM d WHERE more > 0 GROUP BY item_id)
SELECT w.item_id, coalesce(extra, '') AS extra FROM w JOIN w n ON n.item_id = w.item_id + 1 LEFT JOIN x ON x.item_id = w.item_id""",
    "conditional_counts": "SELECT lang, count(*) AS n, count(*) FILTER (toxic = 1) AS toxic, count(*) FILTER (quality = 1) AS good, CAST(sum(n_chars) AS BIGINT) AS chars, count(*) FILTER (quality = 1) * 100.0::DOUBLE / count(*) AS good_pct FROM documents JOIN labels USING (doc_id) GROUP BY lang",
    "weighted_majority": "SELECT l_suppkey, sum(CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS BIGINT) ELSE 0 END) * 2 >= sum(CAST(l_quantity AS BIGINT)) AS majority FROM lineitem GROUP BY l_suppkey",
    "union_all": "SELECT 'customer' AS kind, c_custkey AS id, c_name AS title FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier",
}
