"""Ordered-sequence operators. Every one takes the group key and the order explicitly: Spark keeps no row order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuewright.session import settled


def _over(group: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*group).orderBy(*order)


def _before(group: Sequence[str], order: Sequence[str]):
    return _over(group, order).rowsBetween(Window.unboundedPreceding, -1)


def neighbours(df: DataFrame, group: Sequence[str], order: Sequence[str], column: str) -> DataFrame:
    """Previous and next value, and the first and last of the group."""
    w, whole = _over(group, order), _over(group, order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.withColumns({f"prev_{column}": F.lag(column).over(w), f"next_{column}": F.lead(column).over(w), f"first_{column}": F.first(column).over(whole), f"last_{column}": F.last(column).over(whole)})


def line_spacing(lines: DataFrame, group: Sequence[str], order: Sequence[str], top: str = "y_min", bottom: str = "y_max") -> DataFrame:
    """Space to the line above and below; null at the ends of a page."""
    w = _over(group, order)
    return lines.withColumns({"top_spacing": F.col(top) - F.lag(bottom).over(w), "bottom_spacing": F.lead(top).over(w) - F.col(bottom)})


def ranged(df: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows dealt by ranges of group and order, with the number of their range and a text of their group that also tells nulls apart.

    A group with a third of all rows lies in many ranges, so what runs along it can be put together from the ranges.
    """
    keys = [*group, *order]
    return settled(df.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()).withColumn("_group", F.to_json(F.struct(*group)) if group else F.lit("")))


def _within(order: Sequence[str]):
    return Window.partitionBy("_group", "_part").orderBy(*order)


def with_totals_before(spread: DataFrame, **totals: Column) -> DataFrame:
    """Rows of `ranged` with sums over the earlier ranges of their group, from one row per group and range."""
    each = spread.groupBy("_group", "_part").agg(*(c.alias(name) for name, c in totals.items()))
    earlier = Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # at most one row per range
    return spread.join(each.select("_group", "_part", *(F.coalesce(F.sum(name).over(earlier), F.lit(0)).alias(name) for name in totals)), ["_group", "_part"])


def offsets(df: DataFrame, group: Sequence[str], order: Sequence[str], count: str, out: str = "offset") -> DataFrame:
    """Exclusive prefix sum of counts or lengths. Ties of the order must not matter or not occur. Null counts add nothing."""
    spread = with_totals_before(ranged(df, group, order), _before=F.coalesce(F.sum(count), F.lit(0)))
    own = F.coalesce(F.sum(count).over(_within(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return spread.withColumn(out, F.col("_before") + own).drop("_part", "_group", "_before")


def paginate(df: DataFrame, group: Sequence[str], order: Sequence[str], words: str, words_per_page: int = 300) -> DataFrame:
    """The page of a line follows from the words of the lines before it."""
    before = offsets(df, group, order, words, "_words_before")
    return before.withColumn("page", (F.floor(F.col("_words_before") / words_per_page) + 1).cast("long")).drop("_words_before")


def merged_intervals(df: DataFrame, group: Sequence[str], start: str = "start", finish: str = "finish") -> DataFrame:
    """Union of closed intervals; intervals that touch are merged."""
    reach = F.max(finish).over(_before(group, [start, finish]))
    flagged = df.withColumn("_new", F.when(F.col(start) <= reach, 0).otherwise(1))
    grouped = flagged.withColumn("_island", F.sum("_new").over(_over(group, [start, finish]).rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy(*group, "_island").agg(F.min(start).alias(start), F.max(finish).alias(finish), F.count("*").alias("n_merged")).drop("_island")


def runs(df: DataFrame, group: Sequence[str], order: Sequence[str], key: str, out: str = "run") -> DataFrame:
    """Number of the run of equal keys that a row belongs to, from 1. Nulls are equal to each other."""
    w = _over(group, order)
    ordinal = F.row_number().over(w)
    changed = F.when((ordinal == 1) | ~F.lag(key).over(w).eqNullSafe(F.col(key)), 1).otherwise(0)
    return df.withColumn("_changed", changed).withColumn(out, F.sum("_changed").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_changed")


def gap_clusters(df: DataFrame, value: str, gap: float = 1.0, group: Sequence[str] = ()) -> DataFrame:
    """Distinct values in chains whose steps are at most `gap`. The distinct values of a group are few (sizes of type)."""
    distinct = df.select(*group, value).distinct()
    w = _over(group, [value])
    flagged = distinct.withColumn("_new", F.when(F.col(value) - F.lag(value).over(w) <= gap, 0).otherwise(1))
    return flagged.withColumn("cluster", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def segments(df: DataFrame, group: Sequence[str], order: Sequence[str], marker: Column, out: str = "segment") -> DataFrame:
    """Rows up to the next marker row belong to the marker before them; 0 before the first."""
    return df.withColumn(out, F.count_if(marker).over(_over(group, order).rowsBetween(Window.unboundedPreceding, 0)))


def forward_fill(df: DataFrame, group: Sequence[str], order: Sequence[str], value: Column, out: str) -> DataFrame:
    """The last non-null value so far."""
    return df.withColumn(out, F.last(value, ignorenulls=True).over(_over(group, order).rowsBetween(Window.unboundedPreceding, 0)))


def take_until(df: DataFrame, group: Sequence[str], ordinal: str, stop: Column, keep_stop: bool = False) -> DataFrame:
    """Rows before the first match of each group; all of them if nothing matches."""
    first = df.filter(stop).groupBy(*group).agg(F.min(ordinal).alias("_stop"))
    before = F.col(ordinal) <= F.col("_stop") if keep_stop else F.col(ordinal) < F.col("_stop")
    return df.join(first, list(group), "left").filter(F.col("_stop").isNull() | before).drop("_stop")


def drop_until(df: DataFrame, group: Sequence[str], ordinal: str, start: Column) -> DataFrame:
    """Rows from the first match on; groups without a match give nothing."""
    first = df.filter(start).groupBy(*group).agg(F.min(ordinal).alias("_start"))
    return df.join(first, list(group)).filter(F.col(ordinal) >= F.col("_start")).drop("_start")


def trailing_count(df: DataFrame, key: Sequence[str], ts: str, days: int = 1) -> DataFrame:
    """Rows of the key within the trailing window, the row itself and the boundary included."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    ranged = df.withColumn("_micros", micros)
    w = Window.partitionBy(*key).orderBy("_micros").rangeBetween(-days * 86_400_000_000, 0)
    return ranged.withColumn("trailing", F.count("*").over(w)).drop("_micros")


def sentence_windows(segments_: DataFrame, group: Sequence[str], ordinal: str, longest: float = 14.0, shortest: float = 4.0) -> DataFrame:
    """One window per start that follows a sentence end (or opens the recording): the first sentence end that is
    at least `shortest` after it, unless a segment on the way ends more than `longest` after it.

    Columns start_s, finish_s, ends_sentence. The join is bounded: finish lies within `longest` of the start, so a
    start meets the segments of a few seconds only; starts are dealt with a bucket key as long as the window.
    """
    w = _over(group, [ordinal])
    flagged = segments_.withColumn("_opens", F.coalesce(F.lag("ends_sentence").over(w), F.lit(True)))
    bucket = F.floor(F.col("start_s") / longest)
    starts = flagged.filter("_opens").select(*group, F.col(ordinal).alias("first"), F.col("start_s").alias("from_s")).withColumn("_bucket", F.explode(F.array(F.floor(F.col("from_s") / longest), F.floor(F.col("from_s") / longest) + 1)))
    reach = starts.join(flagged.withColumn("_bucket", bucket), [*group, "_bucket"]).filter(F.col(ordinal) >= F.col("first"))
    length = F.col("finish_s") - F.col("from_s")
    ends = reach.groupBy(*group, "first", "from_s").agg(
        F.min(F.when(length > longest, F.col(ordinal))).alias("_over"), F.min(F.when(F.col("ends_sentence") & (length >= shortest) & (length <= longest), F.struct(F.col(ordinal).alias("last"), F.col("finish_s").alias("to_s")))).alias("_end")
    )
    return ends.filter(F.col("_end").isNotNull() & (F.col("_over").isNull() | (F.col("_end.last") < F.col("_over")))).select(*group, "first", "_end.last", "from_s", "_end.to_s")


def speaker_turns(df: DataFrame, group: Sequence[str], order: Sequence[str], turn: Column, speakers: int | None = None) -> DataFrame:
    """Speaker id = turn flags before the row, modulo the number of speakers if that is given."""
    flags = F.coalesce(F.sum(F.when(turn, 1).otherwise(0)).over(_before(group, order)), F.lit(0))
    return df.withColumn("speaker", flags % speakers if speakers else flags)


def cuts(total: int, step: int = 60) -> Column:
    """Starts of consecutive cuts of a recording."""
    return F.sequence(F.lit(0), F.lit(max(0, total - 1)), F.lit(step))


def batches(df: DataFrame, order: Sequence[str], size: int, group: Sequence[str] = ()) -> DataFrame:
    """Number of the slice of `size` rows that a row belongs to, from 0."""
    spread = with_totals_before(ranged(df, group, order), _before=F.count("*"))
    place = F.col("_before") + F.row_number().over(_within(order)) - 1
    return spread.withColumn("batch", F.floor(place / size).cast("long")).drop("_part", "_group", "_before")


def global_ordinal(df: DataFrame, order: Sequence[str], out: str = "ordinal") -> DataFrame:
    """Position in the global order, from 1, without one task that holds all rows: ranges, their sizes, then an offset."""
    spread = with_totals_before(ranged(df, (), order), _before=F.count("*"))
    return spread.withColumn(out, F.col("_before") + F.row_number().over(_within(order))).drop("_part", "_group", "_before")
