"""Queries of the ordered-sequence operators on the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuewright.operators import aggregates, state, windows
from cuewright.session import table

MICROS_A_SECOND = 1_000_000


def micros(column: str):
    return F.unix_micros(F.col(column).cast("timestamp"))


def interval_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Activity of each user; an event is busy for `value` seconds."""
    events = table(spark, sf_dir, "events").select("user_id", micros("ts").alias("start"), (micros("ts") + (F.col("value").cast("decimal(18,2)") * MICROS_A_SECOND * 60).cast("long")).alias("finish"))
    return windows.merged_intervals(events, ["user_id"])


def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The roles around each turn."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.xxhash64("text").alias("tie"))
    return windows.neighbours(turns, ["conv_id"], ["turn", "role"], "role").drop("tie")


def role_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of one role after another."""
    turns = windows.runs(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), ["conv_id"], ["turn", "role"], "role")
    return turns.groupBy("conv_id", "run").agg(F.min("role").alias("role"), F.count("*").alias("turns"), F.min("turn").alias("first_turn"))


def segment_marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user turn opens a segment."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return windows.segments(turns, ["conv_id"], ["turn", "role"], F.col("role") == "user")


def forward_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn with the latest user turn."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return windows.forward_fill(turns, ["conv_id"], ["turn", "role"], F.when(F.col("role") == "user", F.col("turn")), "user_turn")


def take_until(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns before the first long one."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.length("text").alias("n_chars"))
    return windows.take_until(turns, ["conv_id"], "turn", F.col("n_chars") > 400)


def drop_until(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns from the first answer on."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return windows.drop_until(turns, ["conv_id"], "turn", F.col("role") == "assistant")


def speaker_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speakers by the number of user turns before, modulo 3."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return windows.speaker_turns(turns, ["conv_id"], ["turn", "role"], F.col("role") == "user", 3)


def rolling_24h(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the user in the 24 hours up to each event."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return windows.trailing_count(events, ["user_id"], "ts").select("event_id", "user_id", "trailing")


def word_count(column: str):
    return F.size(F.filter(F.split(column, r"\s+"), lambda w: w != ""))


def paginate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a source as lines of one book."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count("text").alias("words"))
    return windows.paginate(docs, ["source"], ["doc_id"], "words")


def prefix_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of a source before each document."""
    return windows.offsets(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), ["source"], ["doc_id"], "n_chars")


def gap_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squares of the sizes of a part type in chains of steps of at most 40."""
    return windows.gap_clusters(table(spark, sf_dir, "part").select("p_type", (F.col("p_size") * F.col("p_size")).cast("long").alias("square")), "square", 40, ["p_type"])


def line_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days between the items of an order, an item taking as many days as its quantity."""
    day = F.unix_date(F.col("l_shipdate").cast("date"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", day.alias("y_min"), (day + F.col("l_quantity").cast("int")).alias("y_max"))
    return windows.line_spacing(lines, ["l_orderkey"], ["l_linenumber", "l_partkey", "y_min"])


def batch_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a language in slices of 50."""
    docs = windows.batches(table(spark, sf_dir, "documents").select("doc_id", "lang"), ["doc_id"], 50, ["lang"])
    return docs.groupBy("lang", "batch").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))


def fixed_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document cut every 1000 characters."""
    docs = table(spark, sf_dir, "documents").filter("n_chars > 0")
    return docs.select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_chars") - 1, F.lit(1000).cast("long"))).alias("start"))


def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q1: sends of each event type at least two minutes apart, in microseconds."""
    events = table(spark, sf_dir, "events").select("event_id", "event_type", micros("ts").alias("asked_at"))
    return state.rate_limited(events, ["event_type"], ["asked_at", "event_id"], "asked_at", 120 * MICROS_A_SECOND)


def user_slot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q3: one slot per user; an event occupies it for `value` minutes."""
    service = (F.col("value").cast("decimal(18,2)") * 60 * MICROS_A_SECOND).cast("long")
    events = table(spark, sf_dir, "events").select("event_id", "user_id", micros("ts").alias("arrival"), service.alias("service"))
    return state.one_slot(events, ["user_id"], ["arrival", "event_id"], "arrival", "service")


def edit_coalescing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q2: of the events of a user in the same hour, the latest type at the place of the first."""
    events = table(spark, sf_dir, "events").select("user_id", F.floor(micros("ts") / (3600 * MICROS_A_SECOND)).alias("hour"), "event_id", "event_type")
    return state.coalesced(events, ["user_id"], "hour", "event_id", "event_type")


def latest_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user and type."""
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value", micros("ts").alias("at_us"))
    return aggregates.latest(events, ["user_id", "event_type"], ["at_us", "event_id"])


def until_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q9: events of each hour of the log up to the first error of that hour."""
    events = table(spark, sf_dir, "events").select("event_id", "event_type", F.floor(micros("ts") / (3600 * MICROS_A_SECOND)).alias("hour"))
    return state.until_failure(events, "event_id", F.col("event_type") == "error", ["hour"])


SQL = {
    "interval_merge": """
WITH e AS (SELECT user_id, epoch_us(ts) AS start, epoch_us(ts) + CAST(CAST(value AS DECIMAL(18,2)) * 60000000 AS BIGINT) AS finish FROM events),
r AS (SELECT *, max(finish) OVER (PARTITION BY user_id ORDER BY start, finish ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM e),
g AS (SELECT *, sum(CASE WHEN start <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY start, finish ROWS UNBOUNDED PRECEDING) AS island FROM r)
SELECT user_id, min(start) AS start, max(finish) AS finish, count(*) AS n_merged FROM g GROUP BY user_id, island""",
    "neighbours": """
SELECT conv_id, turn, role, lag(role) OVER w AS prev_role, lead(role) OVER w AS next_role, first_value(role) OVER f AS first_role, last_value(role) OVER f AS last_role FROM conversations
WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role), f AS (PARTITION BY conv_id ORDER BY turn, role ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""",
    "role_runs": """
WITH c AS (SELECT *, CASE WHEN lag(role) OVER w IS NOT DISTINCT FROM role AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS changed FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role)),
r AS (SELECT *, CAST(sum(changed) OVER (PARTITION BY conv_id ORDER BY turn, role ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM c)
SELECT conv_id, run, min(role) AS role, count(*) AS turns, min(turn) AS first_turn FROM r GROUP BY conv_id, run""",
    "segment_marker": "SELECT conv_id, turn, role, count(*) FILTER (role = 'user') OVER (PARTITION BY conv_id ORDER BY turn, role ROWS UNBOUNDED PRECEDING) AS segment FROM conversations",
    "forward_fill": "SELECT conv_id, turn, role, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn, role ROWS UNBOUNDED PRECEDING) AS user_turn FROM conversations",
    "take_until": """
WITH s AS (SELECT conv_id, min(turn) AS stop FROM conversations WHERE length(text) > 400 GROUP BY conv_id)
SELECT c.conv_id, c.turn, c.role, CAST(length(c.text) AS INTEGER) AS n_chars FROM conversations c LEFT JOIN s USING (conv_id) WHERE stop IS NULL OR turn < stop""",
    "drop_until": "SELECT c.conv_id, c.turn, c.role FROM conversations c JOIN (SELECT conv_id, min(turn) AS start FROM conversations WHERE role = 'assistant' GROUP BY conv_id) s USING (conv_id) WHERE turn >= start",
    "speaker_turns": "SELECT conv_id, turn, role, CAST(coalesce(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn, role ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 3 AS BIGINT) AS speaker FROM conversations",
    "rolling_24h": "SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS trailing FROM events",
    "paginate": r"""
WITH d AS (SELECT doc_id, source, CAST(len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS INTEGER) AS words FROM documents)
SELECT *, CAST(coalesce(sum(words) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) // 300 + 1 AS page FROM d""",
    "prefix_offsets": 'SELECT doc_id, source, n_chars, CAST(coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM documents',
    "gap_cluster": """
WITH d AS (SELECT DISTINCT p_type, CAST(p_size * p_size AS BIGINT) AS square FROM part),
f AS (SELECT *, CASE WHEN square - lag(square) OVER (PARTITION BY p_type ORDER BY square) <= 40 THEN 0 ELSE 1 END AS fresh FROM d)
SELECT p_type, square, CAST(sum(fresh) OVER (PARTITION BY p_type ORDER BY square ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cluster FROM f""",
    "line_spacing": """
WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS INTEGER) AS y_min, l_quantity FROM lineitem),
m AS (SELECT l_orderkey, l_linenumber, l_partkey, y_min, CAST(y_min + CAST(l_quantity AS INTEGER) AS INTEGER) AS y_max FROM l)
SELECT *, CAST(y_min - lag(y_max) OVER w AS INTEGER) AS top_spacing, CAST(lead(y_min) OVER w - y_max AS INTEGER) AS bottom_spacing FROM m WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, y_min)""",
    "batch_slices": """
WITH b AS (SELECT doc_id, lang, (row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) // 50 AS batch FROM documents)
SELECT lang, batch, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id FROM b GROUP BY lang, batch""",
    "fixed_cuts": "SELECT doc_id, unnest(range(0, n_chars, 1000)) AS start FROM documents WHERE n_chars > 0",
    "rate_limit": """
WITH e AS (SELECT event_id, event_type, epoch_us(ts) AS asked_at, row_number() OVER (PARTITION BY event_type ORDER BY epoch_us(ts), event_id) - 1 AS i FROM events)
SELECT event_id, event_type, asked_at, CAST(max(asked_at - i * 120000000) OVER (PARTITION BY event_type ORDER BY asked_at, event_id ROWS UNBOUNDED PRECEDING) + i * 120000000 AS BIGINT) AS send_at FROM e""",
    "user_slot": """
WITH e AS (SELECT event_id, user_id, epoch_us(ts) AS arrival, CAST(CAST(value AS DECIMAL(18,2)) * 60000000 AS BIGINT) AS service FROM events),
s AS (SELECT *, CAST(sum(service) OVER (PARTITION BY user_id ORDER BY arrival, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM e),
f AS (SELECT event_id, user_id, arrival, service, max(arrival - (total - service)) OVER (PARTITION BY user_id ORDER BY arrival, event_id ROWS UNBOUNDED PRECEDING) + total AS finish_at FROM s)
SELECT *, finish_at - service AS start_at FROM f""",
    "edit_coalescing": "SELECT user_id, epoch_us(ts) // 3600000000 AS hour, min(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, count(*) AS merged FROM events GROUP BY 1, 2",
    "latest_by_key": """
SELECT user_id, event_type, event_id, value, at_us FROM (
  SELECT user_id, event_type, event_id, value, epoch_us(ts) AS at_us, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events
) WHERE n = 1""",
    "until_failure": """
WITH e AS (SELECT event_id, event_type, epoch_us(ts) // 3600000000 AS hour FROM events), s AS (SELECT hour, min(event_id) AS stop FROM e WHERE event_type = 'error' GROUP BY hour)
SELECT hour, event_id, event_type FROM e LEFT JOIN s USING (hour) WHERE stop IS NULL OR event_id < stop""",
}
