"""Streaming jobs over events; each takes a batch or a streaming DataFrame with a time column ts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def usage(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """start, event_type, n, total: tumbling hours; events later than the watermark are left out of a stream."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    g = e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding_usage(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """start, user_id, used: units by sliding minute, every ten seconds."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    g = e.groupBy(F.window("ts", "60 seconds", "10 seconds").alias("w"), "user_id").agg(F.sum(F.greatest("value", F.lit(0.0))).alias("used"))
    return g.select(F.col("w.start").alias("start"), "user_id", "used")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """user_id, start, n: sessions closed by a gap."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    g = e.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("w.start").alias("start"), "n")


def once(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Each event once by its id, within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else events.dropDuplicates(["event_id"])


ADMITTED = "user_id bigint, event_id bigint, granted boolean, used double"


def admit(events: DataFrame, budget: float = 200.0, span: float = 60.0, late: str = "10 minutes") -> DataFrame:
    """user_id, event_id, granted, used: requests of a user admitted while the last minute's grants fit a budget.

    State holds the grants of the last minute only; it is dropped when a user stays away.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = list(zip(*state.get)) if state.exists else []
        out = []
        for row in pd.concat(frames).sort_values(["ts", "event_id"]).itertuples():
            now, units = row.ts.timestamp(), max(row.value, 0.0)
            held = [(t, u) for t, u in held if t > now - span]
            used = sum(u for _, u in held)
            granted = used + units <= budget
            if granted:
                held.append((now, units))
            out.append((key[0], row.event_id, granted, used + units * granted))
        state.update(([t for t, _ in held], [u for _, u in held]))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), int(now * 1000)) + 600_000)
        yield pd.DataFrame(out, columns=["user_id", "event_id", "granted", "used"])

    timed = events.withWatermark("ts", late).groupBy("user_id")
    return timed.applyInPandasWithState(step, ADMITTED, "times array<double>, units array<double>", "append", GroupStateTimeout.EventTimeTimeout)
