"""Joins by key, by overlap and by position."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A dimension table is broadcast only if the planner puts it at no more than this many bytes; beyond, adaptive execution decides.
BROADCAST_BYTES = 32 << 20


def small(df: DataFrame) -> DataFrame:
    """Broadcast df if the planner's estimate, which errs upwards, is below the bound. No job runs for it."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def bucketed(start: Column, finish: Column, width: float) -> Column:
    """Numbers of the time buckets that an interval touches: the equi-join key of an overlap join."""
    return F.sequence(F.floor(start / width), F.floor(finish / width))


def max_overlap(words: DataFrame, segments: DataFrame, group: Sequence[str], word_id: str, label: str = "speaker_id", width: float = 60.0) -> DataFrame:
    """The segment that overlaps a word most, or else the nearest; ties by the later start, then the earlier finish.

    words: group, word_id, start_s, finish_s; segments: group, label, start_s, finish_s. Overlap is found with a bucket
    key, so a word meets the segments of its own buckets only; the words left over are matched with the segment that
    ends last before them and the one that starts first after them.
    """
    w = words.select(*group, word_id, F.col("start_s").alias("ws"), F.col("finish_s").alias("wf"))
    s = segments.select(*group, label, F.col("start_s").alias("ss"), F.col("finish_s").alias("sf"))
    near = w.withColumn("_b", F.explode(bucketed(F.col("ws"), F.col("wf"), width))).join(s.withColumn("_b", F.explode(bucketed(F.col("ss"), F.col("sf"), width))), [*group, "_b"])
    overlap = F.least("wf", "sf") - F.greatest("ws", "ss")
    choice = F.struct(overlap.alias("o"), F.col("ss"), (-F.col("sf")).alias("nf"), F.col(label))
    hits = near.filter(overlap >= 0).groupBy(*group, word_id).agg(F.max_by(label, choice).alias(label))
    rest = w.join(hits.select(*group, word_id), [*group, word_id], "left_anti")
    # Nearest segments around a place: carry the best one so far along the order of time, once forwards, once backwards.
    places = rest.select(*group, word_id, F.lit(None).cast(s.schema[label].dataType).alias(label), F.col("ws").alias("at"), F.col("wf").alias("to"), F.lit(1).alias("kind"), "ws", "wf")
    by_end = s.select(*group, F.lit(None).cast(w.schema[word_id].dataType).alias(word_id), label, F.col("sf").alias("at"), F.col("sf").alias("to"), F.lit(0).alias("kind"), F.col("ss").alias("ws"), F.col("sf").alias("wf"))
    by_start = s.select(*group, F.lit(None).cast(w.schema[word_id].dataType).alias(word_id), label, F.col("ss").alias("at"), F.col("ss").alias("to"), F.lit(0).alias("kind"), F.col("ss").alias("ws"), F.col("sf").alias("wf"))
    seg = F.when(F.col("kind") == 0, F.struct(F.col("ws").alias("ss"), (-F.col("wf")).alias("nf"), F.col(label).alias(label)))
    ahead = Window.partitionBy(*group).orderBy("at", "kind", F.coalesce("ws", F.lit(0.0))).rowsBetween(Window.unboundedPreceding, 0)
    before = places.unionByName(by_end).withColumn("left", F.last(F.when(F.col("kind") == 0, F.struct(F.col("wf").alias("sf"), seg.alias("seg"))), ignorenulls=True).over(ahead)).filter("kind = 1").select(*group, word_id, "ws", "wf", "left")
    behind = Window.partitionBy(*group).orderBy(F.col("to").desc(), F.col("kind"), F.coalesce("ws", F.lit(0.0))).rowsBetween(Window.unboundedPreceding, 0)
    after = places.unionByName(by_start).withColumn("right", F.last(F.when(F.col("kind") == 0, F.struct(F.col("ws").alias("ss"), seg.alias("seg"))), ignorenulls=True).over(behind)).filter("kind = 1").select(*group, word_id, "right")
    both = before.join(after, [*group, word_id])
    left_gap, right_gap = F.col("ws") - F.col("left.sf"), F.col("right.ss") - F.col("wf")
    nearest = F.when(F.col("left").isNull(), F.col("right.seg")).when(F.col("right").isNull(), F.col("left.seg")).when(left_gap < right_gap, F.col("left.seg")).when(right_gap < left_gap, F.col("right.seg")).otherwise(F.greatest("left.seg", "right.seg"))
    return hits.unionByName(both.select(*group, word_id, nearest[label].alias(label)))


def first_match(probe: DataFrame, build: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Inner join with the first build row of each key; probe rows repeat as they are."""
    from cuewright.operators.aggregates import first_of

    return probe.join(first_of(build, key, order), list(key))


def pending(items: DataFrame, done: DataFrame, key: Sequence[str]) -> DataFrame:
    """Items that are not done yet."""
    return items.join(done.select(*key).distinct(), list(key), "left_anti")


def by_position(left: DataFrame, right: DataFrame, ordinal: str) -> DataFrame:
    """Rows side by side by their ordinal; a row without a partner is an error."""
    sides = left.withColumn("_left", F.lit(True)).join(right.withColumn("_right", F.lit(True)), ordinal, "full_outer")
    return sides.filter(F.when(F.col("_left") & F.col("_right"), True).otherwise(F.raise_error(F.lit("counts differ")).cast("boolean"))).drop("_left", "_right")
