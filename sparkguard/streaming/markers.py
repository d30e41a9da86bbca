"""The latest state per key over a stream of state events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def latest_states(events: DataFrame, key: str, sequence: str, state: str) -> DataFrame:
    """Streaming form of the latest-state query: one running aggregate row per key."""
    return events.groupBy(key).agg(F.max_by(state, sequence).alias("latest_state"), F.max(sequence).alias("latest_sequence"))


def events_per_window(events: DataFrame, at: str, width: str, late: str) -> DataFrame:
    """Counts per tumbling window; events later than ``late`` behind the watermark are dropped."""
    return events.withWatermark(at, late).groupBy(F.window(at, width)).agg(F.count(F.lit(1)).alias("n"))


def keep_table(states: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """Run once over what is there and hold the result as an in-memory table of that name."""
    return states.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
