"""De-duplication of repeated records."""

from __future__ import annotations

from pyspark.sql import DataFrame

from basin.operators._common import as_list
from basin.operators.dispositions import first_wins
from basin.streaming.windows import event_time


def dedup_stream(df: DataFrame, ts: str, keys, lateness: str) -> DataFrame:
    """Drop records whose ``keys`` were already seen.

    On a stream, state per key is kept until the watermark (``lateness`` behind the newest event)
    passes the first copy's event time. Rows older than the watermark when they arrive are dropped,
    first copies too: choose ``lateness`` above the longest delay of a record. On a batch, every repeat is dropped and the earliest copy by ``ts`` is kept.
    """
    keys = as_list(keys)
    if df.isStreaming:
        return event_time(df, ts).withWatermark(ts, lateness).dropDuplicatesWithinWatermark(keys)
    return first_wins(df, keys, [ts])
