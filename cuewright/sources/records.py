"""Keyed logs in JSON Lines, caches, and option lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuewright.operators.aggregates import latest


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a log with their place (file and line are not kept by Spark, so writers add `at`). A missing log is empty; a malformed line is an error."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def append_log(records: DataFrame, path: str) -> None:
    """K5: add records; each job adds files of its own, so writers do not disturb each other."""
    records.write.mode("append").json(path)


def compacted(log: DataFrame, live: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last record of every key that is still live."""
    return latest(log, key, order).join(live.select(*key).distinct(), list(key), "left_semi")


def write_report(df: DataFrame, path: str, form: str = "json") -> None:
    """K3, K4: a report as JSON, or as CSV with a header."""
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if form == "csv" else writer.json(path)


def cached(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Cache records whose file still has the size and time of then."""
    return files.select("path", "bytes", "mtime").join(cache, ["path", "bytes", "mtime"])


def option_map(line: Column) -> Column:
    """key[=value] words as a map; a word without a value means 1, a later one wins."""
    words = F.filter(F.split(line, r"\s+"), lambda w: (w != "") & ~w.rlike("^[a-z][a-z0-9+.-]*://"))
    pairs = F.transform(words, lambda w: F.struct(F.regexp_extract(w, "^([^=]*)", 1).alias("key"), F.when(w.contains("="), F.regexp_extract(w, "=(.*)$", 1)).otherwise("1").alias("value")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(last)


def input_lines(messages: DataFrame, id_col: str = "message_id", text_col: str = "text", most: int = 10) -> DataFrame:
    """One row per line with a URL: the URL and its options, over those of the lines before the first URL; more than `most` URLs are an error."""
    from cuewright.operators.cues import merged_maps

    lines = messages.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("line", "text"))
    url = F.regexp_extract("text", r"(?:^|\s)([a-z][a-z0-9+.-]*://\S+)", 1)
    parsed = lines.select(id_col, "line", url.alias("url"), option_map(F.col("text")).alias("options"))
    urls = parsed.filter("url <> ''")
    first = urls.groupBy(id_col).agg(F.min("line").alias("first"))
    before = parsed.join(first, id_col).filter("line < first").groupBy(id_col).agg(F.aggregate(F.array_sort(F.collect_list(F.struct("line", F.map_entries("options").alias("e")))), F.map_from_entries(F.array().cast("array<struct<key:string,value:string>>")), lambda m, x: merged_maps(m, F.map_from_entries(x["e"]))).alias("inherited"))
    from pyspark.sql import Window

    ranked = urls.withColumn("n", F.row_number().over(Window.partitionBy(id_col).orderBy("line")))
    ranked = ranked.withColumn("n", F.when(F.col("n") <= most, F.col("n")).otherwise(F.raise_error(F.lit(f"too many URLs (maximum {most})")).cast("int")))
    joined = ranked.join(before, id_col, "left")
    return joined.select(id_col, "n", "url", F.when(F.col("inherited").isNull(), F.col("options")).otherwise(merged_maps(F.col("inherited"), F.col("options"))).alias("options"))


def netscape_cookies(lines: DataFrame, text_col: str = "value") -> DataFrame:
    """Names of cookies by domain from seven tab-separated fields; values stay out of the tables."""
    fields = F.split(F.regexp_replace(text_col, "^#HttpOnly_", ""), "\t")
    rows = lines.filter(~F.col(text_col).rlike(r"^\s*$|^#(?!HttpOnly_)")).select(fields.alias("f")).filter(F.size("f") == 7)
    return rows.groupBy(F.get("f", F.lit(0)).alias("domain")).agg(F.array_sort(F.collect_set(F.get("f", F.lit(5)))).alias("names"))


def cache_key(options: Column) -> Column:
    """A short digest of a map of options, whatever their order."""
    return F.left(F.sha2(F.to_json(F.array_sort(F.map_entries(options))), 256), F.lit(16))
