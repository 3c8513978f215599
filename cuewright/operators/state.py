"""Queues, rate limits and job registries as batch expressions over their event logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rate_limited(df: DataFrame, group: Sequence[str], order: Sequence[str], t: str, interval: float | int) -> DataFrame:
    """Q1: when each request is sent if sends are at least `interval` apart: i * d + max over j <= i of (t_j - j * d).

    Places and maxima are carried from range to range, so a group with most of the requests is no single task.
    """
    from cuewright.operators.windows import ranged, with_totals_before

    spread = with_totals_before(ranged(df, group, order), _before=F.count("*"))
    inside = Window.partitionBy("_group", "_part").orderBy(*order)
    placed = spread.withColumn("_i", (F.col("_before") + F.row_number().over(inside) - 1).cast("long")).withColumn("_lead", F.col(t) - F.col("_i") * F.lit(interval))
    each = placed.groupBy("_group", "_part").agg(F.max("_lead").alias("_most"))
    earlier = each.select("_group", "_part", F.max("_most").over(Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)).alias("_most"))  # one row per range
    most = F.greatest("_most", F.max("_lead").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    return placed.join(earlier, ["_group", "_part"]).withColumn("send_at", most + F.col("_i") * F.lit(interval)).drop("_i", "_lead", "_most", "_before", "_part", "_group")


def one_slot(df: DataFrame, group: Sequence[str], order: Sequence[str], arrival: str, service: str) -> DataFrame:
    """Q3: start and finish of jobs of users with one slot each, first come first served."""
    w = Window.partitionBy(*group).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    summed = df.withColumn("_sum", F.sum(service).over(upto)).withColumn("_idle", F.col(arrival) - (F.col("_sum") - F.col(service)))
    return summed.withColumn("finish_at", F.max("_idle").over(upto) + F.col("_sum")).withColumn("start_at", F.col("finish_at") - F.col(service)).drop("_sum", "_idle")


def slots_with_bypass(df: DataFrame, group: Sequence[str], order: Sequence[str], arrival: str, service: str, bypass: Column) -> DataFrame:
    """Q3: as `one_slot`; jobs that bypass the queue (administrators, stop commands) start when they arrive and hold no slot."""
    flagged = df.withColumn("_bypass", F.coalesce(bypass, F.lit(False)))
    queued = one_slot(flagged.filter("NOT _bypass"), group, order, arrival, service)
    free = flagged.filter("_bypass").withColumn("finish_at", F.col(arrival) + F.col(service)).withColumn("start_at", F.col(arrival))
    return queued.unionByName(free).drop("_bypass")


def coalesced(df: DataFrame, key: Sequence[str], release: str, ordinal: str, payload: str) -> DataFrame:
    """Q2: of the edits of a key that wait for the same release, the latest payload at the place of the first."""
    return df.groupBy(*key, release).agg(F.min(ordinal).alias(ordinal), F.max_by(payload, ordinal).alias(payload), F.count("*").alias("merged"))


def cancel_outcome(state: Column, owner: Column, actor: Column, admin: Column) -> Column:
    """Q4: what a request to cancel a job comes to."""
    return F.when(state.isNull(), "missing").when(~(admin | (owner == actor)), "forbidden").when(state == "finished", "finished").when(state == "cancelled", "already cancelled").otherwise("cancelled")


def until_failure(df: DataFrame, ordinal: str, failed: Column, group: Sequence[str] = ()) -> DataFrame:
    """Q9: results in input order up to the first failed position, of all rows or of each group."""
    first = df.groupBy(*group).agg(F.min(F.when(failed, F.col(ordinal))).alias("_first"))
    joined = df.join(first, list(group)) if group else df.crossJoin(F.broadcast(first))  # without groups: one row
    return joined.filter(F.col("_first").isNull() | (F.col(ordinal) < F.col("_first"))).drop("_first")


def tail(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """The last n (1 to 1000) records."""
    return df.orderBy(*(F.col(c).desc() for c in order)).limit(min(1000, max(1, n)))
