"""Aggregations over keyed records."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once a row however often `use` mentions it, also inside lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def nearest_rank(p: float, column: str) -> Column:
    """A2: the value at the rank ceil(n * p), at least the first."""
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {column})")


def floor_rank(values: Column, p: float) -> Column:
    """A3: the value at the index floor(n * p) of the sorted values, at most the last; null if there are none."""
    return F.get(F.sort_array(values), F.least(F.floor(F.size(values) * F.lit(p)), F.size(values) - 1).cast("int"))


def timing_score(clips: DataFrame, group: Sequence[str], speed: str = "speed", start_error: str = "start_error", end_error: str = "end_error") -> DataFrame:
    """A1: how far clips are from natural speed and from their slots. Tempo is |log2(speed)|: 0 is natural, 1 half or double."""
    tempo = F.abs(F.log2(F.col(speed)))
    squares = F.col(start_error) * F.col(start_error) + F.col(end_error) * F.col(end_error)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    scored = clips.withColumns({"_tempo": tempo, "_squares": squares})
    return scored.groupBy(*group).agg(
        F.count("*").alias("clips"),
        zero(F.sqrt(F.avg(F.col("_tempo") * F.col("_tempo"))) * 100).alias("deviation_index"),
        zero(F.avg("_tempo") * 100).alias("mean_deviation"),
        zero(nearest_rank(0.9, "_tempo") * 100).alias("p90_deviation"),
        zero(F.sqrt(F.sum("_squares") / (2 * F.count("*"))) * 1000).alias("slot_rms_ms"),
        F.min(speed).alias("min_speed"),
        zero(nearest_rank(0.1, speed)).alias("p10_speed"),
        zero(nearest_rank(0.5, speed)).alias("p50_speed"),
        zero(nearest_rank(0.9, speed)).alias("p90_speed"),
        F.max(speed).alias("max_speed"),
    )


def worst(clips: DataFrame, group: Sequence[str], order: Sequence[str], speed: str = "speed", n: int = 10) -> DataFrame:
    """The n clips of each group farthest from natural speed, with their number in the group from 1 and their deviation (percent of an octave).

    Ties go to the earlier clip. Numbers come from ranges; of each group and range only n rows go on.
    """
    from pyspark.sql import Window

    from cuewright.operators.windows import batches

    numbered = batches(clips, order, 1, group).withColumn("index", F.col("batch") + 1).drop("batch").withColumn("deviation", F.abs(F.log2(F.col(speed))) * 100)
    place = F.row_number().over(Window.partitionBy(*group).orderBy(F.col("deviation").desc(), "index"))  # the planner limits each task to n rows of a group first
    return numbered.withColumn("place", place).filter(F.col("place") <= n)


def latest(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last record of each key in the given order."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(*key, "_row.*")


def first_of(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first record of each key; unlike dropDuplicates, always the same one."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(*key, "_row.*")


def mode_first(df: DataFrame, group: Sequence[str], value: str, ordinal: str) -> DataFrame:
    """The most frequent value; of several, the one that occurs first."""
    tallied = df.groupBy(*group, value).agg(F.count("*").alias("n"), F.min(ordinal).alias("_first"))
    return tallied.groupBy(*group).agg(F.max_by(F.struct(value, "n"), F.struct(F.col("n"), -F.col("_first"))).alias("_best")).select(*group, "_best.*")


def trigram_shares(words: pa.Array) -> pa.Array:
    """Distinct share of the trigrams of each list of words; 0 with fewer than three. All lists of a batch at once."""
    counts = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    codes = pc.list_flatten(words).dictionary_encode().indices.to_numpy().astype(np.int64)
    kinds = int(codes.max(initial=0)) + 1
    n = np.maximum(counts - 2, 0)
    row = np.repeat(np.arange(len(counts)), n)
    first = np.repeat(np.cumsum(counts) - counts, n) + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    pairs = np.unique(codes[:-1] * kinds + codes[1:], return_inverse=True)[1] if len(codes) > 1 else codes[:0]  # small numbers, so that three of them fit
    grams = np.unique(pairs[first] * kinds + codes[first + 2], return_inverse=True)[1] if len(first) else first
    distinct = np.bincount(np.unique(row * (int(grams.max(initial=0)) + 1) + grams) // (int(grams.max(initial=0)) + 1), minlength=len(counts)) if len(row) else np.zeros(len(counts), np.int64)
    return pa.array(np.where(n > 0, distinct / np.maximum(n, 1), 0.0), pa.float64())


def trigram_ratio(text: Column) -> Column:
    """Distinct share of the trigrams of the letter runs of a text in small letters; 0 with fewer than three, and for a null."""

    @F.arrow_udf("double")
    def shares(words: pa.Array) -> pa.Array:
        return trigram_shares(words)

    return shares(F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), 0))


def boundary_text(text: Column) -> Column:
    """small letters, single spaces, digits as a token: how running headers are compared."""
    return F.regexp_replace(F.btrim(F.regexp_replace(F.lower(text), r"\s+", " ")), "[0-9]+", "#")


def headers_and_footers(lines: DataFrame, doc: str = "doc_id", page: str = "page", ordinal: str = "line_idx", text: str = "text") -> DataFrame:
    """Texts that open or close at least max(3, ceil(0.3 * pages)) pages of a document, in normal form with their counts.

    The first and the last line of a page count one each; a page of one line counts twice, as both.
    """
    key = boundary_text(F.col(text))
    ends = lines.groupBy(doc, page).agg(F.min_by(key, ordinal).alias("_head"), F.max_by(key, ordinal).alias("_foot"))
    counted = ends.select(doc, F.explode(F.array("_head", "_foot")).alias("boundary")).groupBy(doc, "boundary").agg(F.count("*").alias("n"))
    pages = lines.groupBy(doc).agg(F.count_distinct(page).alias("_pages"))
    return counted.join(pages, doc).filter(F.col("n") >= F.greatest(F.ceil(F.col("_pages") * 3 / 10), F.lit(3))).select(doc, "boundary", "n")


def without_headers(lines: DataFrame, doc: str = "doc_id", page: str = "page", ordinal: str = "line_idx", text: str = "text") -> DataFrame:
    """Lines whose text is no running header or footer, wherever on the page it stands."""
    found = headers_and_footers(lines, doc, page, ordinal, text).select(doc, F.col("boundary").alias("_key"))
    return lines.withColumn("_key", boundary_text(F.col(text))).join(found, [doc, "_key"], "left_anti").drop("_key")


def repeated_boundaries(lines: DataFrame, doc: str = "doc_id", page: str = "page", ordinal: str = "line_idx", text: str = "text") -> DataFrame:
    """Exact first or last texts of pages (in small letters, single spaces) that recur, each page counting a text once; documents under three pages have none."""
    whole = F.btrim(F.regexp_replace(F.lower(text), r"\s+", " "))
    ends = lines.groupBy(doc, page).agg(F.min_by(whole, ordinal).alias("_head"), F.max_by(whole, ordinal).alias("_foot"))
    counted = ends.select(doc, F.explode(F.array_distinct(F.array("_head", "_foot"))).alias("boundary")).groupBy(doc, "boundary").agg(F.count("*").alias("n"))
    pages = lines.groupBy(doc).agg(F.count_distinct(page).alias("_pages")).filter("_pages >= 3")
    return counted.join(pages, doc).filter(F.col("n") >= F.greatest(F.ceil(F.col("_pages") * 3 / 10), F.lit(3))).select(doc, "boundary", "n")


def majority(df: DataFrame, group: Sequence[str], flag: Column, weight: Column) -> DataFrame:
    """Whether flagged rows hold at least half of the weight."""
    return df.groupBy(*group).agg((F.sum(F.when(flag, weight).otherwise(0)) * 2 >= F.sum(weight)).alias("majority"))


def centroids(vectors: DataFrame, label: str, vector: str) -> DataFrame:
    """Element-wise mean of the vectors of a label, by position, combined on the map side."""
    each = vectors.select(label, F.posexplode(vector).alias("i", "x")).groupBy(label, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return each.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("centroid"))


def cosine(a: Column, b: Column) -> Column:
    """cosine of two vectors; a vector of length 0 is an error."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    product = norm(a) * norm(b)
    return F.when(product > 0, dot / product).otherwise(F.raise_error(F.lit("a vector has no length")).cast("double"))


def share_of(flag: Column) -> Column:
    """Percentage of flagged rows."""
    return F.count_if(flag) * F.lit(100.0) / F.count("*")


def without_boundaries(lines: DataFrame, doc: str = "doc_id", page: str = "page", ordinal: str = "line_idx", text: str = "text", contained: int = 40) -> DataFrame:
    """Lines without what recurs at page boundaries: a first or last line whose normal form does, any line whose exact text does, and any line that
    holds such a text of `contained` characters or more. Documents under three pages stay as they are; each page counts a text once.

    What recurs in one document is a handful of texts, so the join by document alone stays small.
    """
    from pyspark.sql import Window

    whole = F.btrim(F.regexp_replace(F.lower(text), r"\s+", " "))
    w = Window.partitionBy(doc, page)  # the lines of one page
    marked = lines.withColumn("_exact", whole).withColumn("_normal", boundary_text(F.col(text))).withColumn("_edge", (F.col(ordinal) == F.min(ordinal).over(w)) | (F.col(ordinal) == F.max(ordinal).over(w)))
    pages = lines.groupBy(doc).agg(F.count_distinct(page).alias("_pages")).filter("_pages >= 3")

    def recurring(column: str) -> DataFrame:
        counted = marked.filter(F.col("_edge") & (F.col(column) != "")).groupBy(doc, column).agg(F.count_distinct(page).alias("_n"))
        return counted.join(pages, doc).filter(F.col("_n") >= F.greatest(F.ceil(F.col("_pages") * 3 / 10), F.lit(3))).select(doc, column)

    exact = recurring("_exact").withColumnRenamed("_exact", "_seen")
    kept = marked.join(recurring("_normal").withColumn("_hit", F.lit(True)), [doc, "_normal"], "left").filter(~(F.col("_edge") & F.coalesce("_hit", F.lit(False))))
    same = (F.col("_exact") == F.col("_seen")) | ((F.length("_seen") >= contained) & F.col("_exact").contains(F.col("_seen")))
    left = kept.alias("l").join(exact.alias("r"), (F.col(f"l.{doc}") == F.col(f"r.{doc}")) & same, "left_anti")
    return left.drop("_exact", "_normal", "_edge", "_hit")
