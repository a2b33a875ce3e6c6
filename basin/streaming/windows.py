"""Windowed counts and sums over tumbling, sliding and session windows -- batch or stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basin.operators._common import as_list

WINDOW_KINDS = ("tumbling", "sliding", "session")


def event_time(df: DataFrame, ts: str) -> DataFrame:
    """Streams need ``TIMESTAMP`` event time for watermarks; data often holds ``TIMESTAMP_NTZ``
    in UTC. Cast it (the session time zone must be UTC for the instant to stay the same)."""
    if isinstance(df.schema[ts].dataType, T.TimestampNTZType):
        return df.withColumn(ts, F.col(ts).cast("timestamp"))
    return df


def window_metrics(df: DataFrame, ts: str, keys, kind: str, size: str | None = None, slide: str | None = None,
                   gap: str | None = None, lateness: str | None = None, value: str | None = None) -> DataFrame:
    """``count`` (and ``sum(value)``) per key and window.

    ``tumbling`` uses ``size``; ``sliding`` uses ``size`` and ``slide``; ``session`` uses ``gap``
    (a new session starts when the next event is MORE than ``gap`` after the previous one; an
    event exactly ``gap`` later still extends the session, as session windows touching at an
    end are merged).
    On a stream, ``lateness`` is required and sets the watermark: rows later than that behind the newest
    event are dropped, and in append mode a window is emitted once the watermark passes its end.
    Output: keys, ``window_start``, ``window_end``, ``n`` [, ``total``]; window bounds keep the
    type of ``ts`` on batch input. Batch session windows use ``basin.streaming.sessions`` so a key
    with a huge share of the events is still spread over many tasks.
    """
    if kind not in WINDOW_KINDS:
        raise ValueError(f"kind must be one of {WINDOW_KINDS}")
    if df.isStreaming and not lateness:
        raise ValueError("a stream needs lateness: rows that arrive later than this behind the newest are dropped")
    keys = as_list(keys)
    if kind == "session" and not df.isStreaming:
        from basin.streaming.sessions import session_windows
        return session_windows(df, ts, keys, gap, value)
    src_type = df.schema[ts].dataType
    x = df
    if df.isStreaming:
        x = event_time(x, ts)
        x = x.withWatermark(ts, lateness)
    if kind == "tumbling":
        w = F.window(F.col(ts), size)
    elif kind == "sliding":
        w = F.window(F.col(ts), size, slide)
    else:
        w = F.session_window(F.col(ts), gap)
    aggs = [F.count(F.lit(1)).alias("n")]
    if value is not None:
        aggs.append(F.sum(value).alias("total"))
    out = x.groupBy(*keys, w.alias("w")).agg(*aggs)
    start, end = F.col("w.start"), F.col("w.end")
    if df.isStreaming and isinstance(src_type, T.TimestampNTZType):
        start, end = start.cast("timestamp_ntz"), end.cast("timestamp_ntz")
    return out.select(*keys, start.alias("window_start"), end.alias("window_end"), *[a for a in ["n", "total"] if a in out.columns])
