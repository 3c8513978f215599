"""Rate limiting, edit coalescing and the trailing log over streams (Q1, Q2, Q7). State is a few numbers per key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SENT = "key string, asked_us long, send_us long"


def rate_limited(requests: DataFrame, interval_us: int) -> DataFrame:
    """Q1: requests(key, asked_us) of a stream with the time at which each may be sent: send = max(next, asked); next = send + interval.

    Requests of one micro-batch are taken in order of time. The state of a key is its next free moment.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        free = state.get[0] if state.exists else 0
        asked = sorted(int(x) for f in frames for x in f.asked_us)
        sends = []
        for t in asked:
            send = max(free, t)
            free = send + interval_us
            sends.append(send)
        state.update((free,))
        yield pd.DataFrame({"key": key[0], "asked_us": asked, "send_us": sends})

    return requests.select("key", "asked_us").groupBy("key").applyInPandasWithState(step, SENT, "free long", "append", GroupStateTimeout.NoTimeout)


def coalesced(edits: DataFrame, watermark: str = "10 minutes", window: str = "2 seconds") -> DataFrame:
    """Q2: edits(key, at timestamp, ordinal, payload): per key and release window the latest payload at the place of the first."""
    return edits.withWatermark("at", watermark).groupBy("key", F.window("at", window).alias("release")).agg(F.min("ordinal").alias("ordinal"), F.max_by("payload", "ordinal").alias("payload"), F.count("*").alias("merged"))


def hourly_counts(events: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Q7: events(key, at timestamp) in sliding days that advance by the hour; late data beyond the watermark is let go."""
    return events.withWatermark("at", watermark).groupBy("key", F.window("at", "24 hours", "1 hour").alias("day")).agg(F.count("*").alias("n"))
