"""Streams give what the batch forms give."""

from pyspark.sql import functions as F

from cuewright.operators import state
from cuewright.streaming import limits


def test_rate_limit_over_batches(spark, tmp_path):
    rows = [("a", 0), ("a", 1), ("b", 5), ("a", 10), ("b", 5), ("a", 11), ("a", 30)]
    for i, part in enumerate((rows[:3], rows[3:5], rows[5:])):
        spark.createDataFrame(part, "key string, asked_us long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key string, asked_us long").option("maxFilesPerTrigger", 10).parquet(str(tmp_path / "in"))
    query = limits.rate_limited(stream, 4).writeStream.format("memory").queryName("sent").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    batch = spark.createDataFrame(rows, "key string, asked_us long").withColumn("i", F.monotonically_increasing_id())
    expected = state.rate_limited(batch, ["key"], ["asked_us", "i"], "asked_us", 4)
    assert sorted((r.key, r.asked_us, r.send_us) for r in spark.table("sent").collect()) == sorted((r.key, r.asked_us, r.send_at) for r in expected.collect())


def test_coalescing_over_a_stream(spark, tmp_path):
    rows = [("k", 0, 1, "x"), ("k", 1, 2, "y"), ("k", 5, 3, "z"), ("k", 4000, 4, "end")]
    df = spark.createDataFrame(rows, "key string, s long, ordinal long, payload string").select("key", F.timestamp_seconds("s").alias("at"), "ordinal", "payload")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = limits.coalesced(stream).writeStream.format("memory").queryName("edits").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted((r.ordinal, r.payload, r.merged) for r in spark.table("edits").collect()) == [(1, "y", 2), (3, "z", 1), (4, "end", 1)]
