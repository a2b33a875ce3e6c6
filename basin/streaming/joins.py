"""Joins of two streams by key and time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basin.operators._common import all_of, as_list
from basin.streaming.windows import event_time


def match_streams(left: DataFrame, right: DataFrame, on, left_ts: str, right_ts: str, earliest: str, latest: str,
                  left_lateness: str | None = None, right_lateness: str | None = None, how: str = "inner",
                  prefix: str = "right_") -> DataFrame:
    """Every left row with the right rows of its key whose time is between ``earliest`` and ``latest`` (intervals, such as
    ``0 minutes`` and ``1 hour``, ends included) after its own.

    ``how``: ``inner``, or ``left`` to keep left rows without a match. Output: the left columns, then the
    right columns under ``prefix``; rows with a NULL key or time match nothing.

    On streams both sides need a lateness: rows later than that behind their side's newest row are dropped. Each
    side is kept in state until no row of the other that may still come can match it, so state is bounded by
    lateness and interval, and an unmatched left row comes out only then. The watermark of the join is the
    slower side's. On batches the same rows come from a plain equi-join with the range as its condition.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be inner or left")
    if left.isStreaming != right.isStreaming:
        raise ValueError("both sides must be streams, or neither")
    if left.isStreaming and not (left_lateness and right_lateness):
        raise ValueError("streams need a lateness on both sides: it bounds the state and decides which rows are dropped")
    names = {c: f"{prefix}{c}" for c in right.columns}
    types = {c: left.schema[c].dataType for c in left.columns} | {names[c]: right.schema[c].dataType for c in right.columns}
    right = right.select([F.col(f"`{c}`").alias(names[c]) for c in right.columns])
    rt = names[right_ts]
    l, r = event_time(left, left_ts), event_time(right, rt)
    if left.isStreaming:
        l, r = l.withWatermark(left_ts, left_lateness), r.withWatermark(rt, right_lateness)
    same = [F.col(k) == F.col(names[k]) for k in as_list(on)]
    near = (F.col(rt) >= F.col(left_ts) + F.expr(f"INTERVAL {earliest}")) & (F.col(rt) <= F.col(left_ts) + F.expr(f"INTERVAL {latest}"))
    out = l.join(r, all_of(same) & near, how)
    back = {left_ts, rt}
    return out.select([F.col(f"`{c}`").cast(types[c]).alias(c) if c in back else F.col(f"`{c}`") for c in out.columns])
