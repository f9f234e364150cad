"""Transfer events as a stream: states, counters, and acknowledgements without duplicates."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

FINAL = ("COMPLETED", "FAILED", "CANCELLED")
#: Which states may follow a state; a final one has none.
NEXT = {"PENDING": ("PENDING", "IN_PROGRESS", *FINAL), "IN_PROGRESS": ("IN_PROGRESS", *FINAL)}


def running_counters(events: DataFrame) -> DataFrame:
    """Messages and bytes by state; for complete or update mode."""
    return events.groupBy("state").agg(F.count("*").alias("n_messages"), F.sum("bytes").alias("n_bytes"))


def windowed_counters(events: DataFrame, *, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Messages and bytes by time window; ``ts`` must be a timestamp with a zone."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "state").agg(F.count("*").alias("n_messages"), F.sum("bytes").alias("n_bytes"))


def acknowledged_once(acks: DataFrame, *, late: str = "1 hour") -> DataFrame:
    """Acknowledgements (transfer_id, offset, ts, ok), the first of each transfer and offset."""
    return acks.withWatermark("ts", late).dropDuplicatesWithinWatermark(["transfer_id", "offset"])


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    now, total, n = state.get if state.exists else ("PENDING", 0, 0)
    rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
    for to, size in zip(rows["state"], rows["bytes"], strict=True):
        if to in NEXT.get(now, ()):
            now = to
            total += 0 if pd.isna(size) else int(size)
            n += 1
    state.update((now, total, n))
    yield pd.DataFrame([(key[0], now, total, n)], columns=["transfer_id", "state", "bytes", "n_applied"])


def states(events: DataFrame) -> DataFrame:
    """The state machine of each transfer (transfer_id, event_id, ts, state, bytes); update mode.

    An event that may not follow the present state, such as any after a final one, is passed over.
    """
    schema = "transfer_id long, state string, bytes long, n_applied long"
    return events.groupBy("transfer_id").applyInPandasWithState(_advance, schema, "state string, bytes long, n_applied long", "update", GroupStateTimeout.NoTimeout)
