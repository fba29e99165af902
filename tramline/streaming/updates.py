"""Updates as a stream: the last message of each stop is kept as state, and each batch's changes are applied to the timetable."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tramline.operators import realtime

#: How long a run's state is kept without a message.
KEPT_MS = 8 * 3600 * 1000
_COLUMNS = ("stop_seq", "delay", "skipped", "cancelled", "ts", "event_id")
SCHEMA = "trip_id long, stop_seq long, delay long, skipped boolean, cancelled boolean, ts long, event_id long"
_STATE = "stop_seq array<long>, delay array<long>, skipped array<boolean>, cancelled array<boolean>, ts array<long>, event_id array<long>"


def latest_stream(updates: DataFrame) -> DataFrame:
    """For each run with a message in a batch, the last message of each of its stops so far; late ones don't replace newer ones.

    updates is a stream of SCHEMA. A run's state is dropped after eight hours without a message.
    """

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        known: dict[int, tuple] = {}
        if state.exists:
            known = {row[0]: row for row in zip(*state.get, strict=True)}
        for frame in frames:
            for row in frame[list(_COLUMNS)].itertuples(index=False, name=None):
                old = known.get(row[0])
                if old is None or (row[4], row[5]) >= (old[4], old[5]):
                    known[row[0]] = row
        rows = [known[k] for k in sorted(known)]
        state.update(tuple(list(c) for c in zip(*rows, strict=True)))
        state.setTimeoutDuration(KEPT_MS)
        yield pd.DataFrame([(key[0], *r) for r in rows], columns=["trip_id", *_COLUMNS])

    return updates.groupBy("trip_id").applyInPandasWithState(fold, SCHEMA, _STATE, "update", GroupStateTimeout.ProcessingTimeTimeout)


def apply_stream(updates: DataFrame, stop_events: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = "10 seconds"):
    """Starts a query that hands each batch's overlay (see realtime.overlay) to sink with the batch's number; a batch that is sent again has the same number.

    every is the time between batches; with None what is there is worked off and the query ends. State that times out makes batches without rows,
    which sink doesn't get; so processAllAvailable() would not return.
    """

    def batch(rows: DataFrame, number: int) -> None:
        if rows.isEmpty():
            return
        sink(realtime.overlay(stop_events, realtime.latest(rows, ["trip_id", "stop_seq"]).select("trip_id", "stop_seq", "delay", "skipped", "cancelled")), number)

    trigger = {"processingTime": every} if every else {"availableNow": True}
    return latest_stream(updates).writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(**trigger).foreachBatch(batch).start()


def windowed_counts(updates: DataFrame, width: str = "10 minutes", late: str = "8 hours") -> DataFrame:
    """Messages by kind and window of event time (column at), with a generous watermark."""
    return updates.withWatermark("at", late).groupBy(F.window("at", width), "kind").agg(F.count("*").alias("messages"), F.avg("delay").alias("delay"))
