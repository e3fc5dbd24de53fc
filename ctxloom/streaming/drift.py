"""Streaming observation windows: event-time aggregates with a watermark, and a count-based drift state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def observations(events: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """events(ts, user_id, value) to (user_id, window, n, mean_value); rows later than the watermark are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "user_id").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"))


def last_n(events: DataFrame, size: int = 10, least: int = 3) -> DataFrame:
    """Per user the drift of the last `size` values, emitted for each micro-batch; state is `size` doubles a user."""

    def update(key, frames: Iterator[pd.DataFrame], state):
        values = list(state.get[0]) if state.exists else []
        for f in frames:
            values = (values + f.sort_values("ts")["value"].tolist())[-size:]
        state.update((values,))
        if len(values) >= least:
            head = values[: max(1, len(values) // 3)]
            yield pd.DataFrame({"user_id": [key[0]], "current": [values[-1]], "baseline": [sum(head) / len(head)]})

    return events.groupBy("user_id").applyInPandasWithState(
        update, "user_id long, current double, baseline double", "values array<double>", "update", "NoTimeout"
    )


def sliding(events: DataFrame, late: str = "10 minutes", width: str = "10 minutes", step: str = "5 minutes") -> DataFrame:
    """As observations(), over windows that overlap."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width, step), "user_id").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"))


def sessions(events: DataFrame, late: str = "10 minutes", gap: str = "5 minutes") -> DataFrame:
    """As observations(), over sessions that end after a gap."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"))


def stream_selected(decided: DataFrame):
    """The chosen rows one by one, best first, without a driver that holds them all."""
    chosen = decided.where("chosen").orderBy("pack_id", F.col("score").desc(), F.col("recency").desc(), "ord")
    yield from chosen.toLocalIterator(prefetchPartitions=True)


def each_batch(stream: DataFrame, handle, checkpoint: str):
    """Start a query that hands each micro-batch to handle(rows, batch id), such as a sink of payloads or alerts."""
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).start()
