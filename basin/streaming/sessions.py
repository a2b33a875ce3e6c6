"""Session windows on batch data without sending a whole key to one task.

Spark's batch ``session_window`` shuffles every event of a key to one task before merging. Here
the events are range-sorted by keys and time into slices, so a key with a third of all events spans many.
A window over the slice tells where sessions start; whether a slice's first event continues a session of an earlier
slice follows from that one's last event, one row for each slice. Events are then added up per session, in each task
first. Semantics equal ``session_window``: an event more than
``gap`` after the previous one starts a new session; the session ends ``gap`` after its last event.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basin.operators._common import all_of, as_list, stored

# fixed values: interval units accepted in gap strings, in microseconds
_UNITS_US = {"microsecond": 1, "millisecond": 1000, "second": 1_000_000, "minute": 60_000_000,
             "hour": 3_600_000_000, "day": 86_400_000_000, "week": 604_800_000_000}


def interval_micros(text: str) -> int:
    """'30 minutes' / '1 hour 30 minutes' / '45s'-style interval text in microseconds."""
    total = 0
    pairs = re.findall(r"(\d+)\s*([a-zA-Z]+)", text)
    if not pairs:
        raise ValueError(f"cannot read interval {text!r}")
    short = {"us": "microsecond", "ms": "millisecond", "s": "second", "sec": "second", "min": "minute",
             "m": "minute", "h": "hour", "d": "day", "w": "week"}
    for num, unit in pairs:
        u = unit.lower().rstrip("s") if unit.lower() not in short else short[unit.lower()]
        u = short.get(u, u)
        if u not in _UNITS_US:
            raise ValueError(f"unknown interval unit {unit!r}")
        total += int(num) * _UNITS_US[u]
    return total


def session_windows(df: DataFrame, ts: str, keys, gap: str, value: str | None = None) -> DataFrame:
    """Batch session windows per ``keys``: keys, ``window_start``, ``window_end``, ``n`` [, ``total``].

    NULL is a key of its own; events without a time are in no session. Slices and the sessions within them are
    written under the shared scratch folder: two evaluations of a range shuffle may draw different bounds.
    """
    keys = as_list(keys)
    names = [f"__k{i}" for i in range(len(keys))]
    gap_expr = F.expr(f"INTERVAL '{interval_micros(gap)}' MICROSECOND")
    total = F.col(value).cast("double") if value is not None else F.lit(None).cast("double")
    events = df.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col(ts).alias("__ts"), total.alias("__v"),
                       F.monotonically_increasing_id().alias("__salt")).where(F.col("__ts").isNotNull())
    order = [*names, "__ts", "__salt"]  # the last spreads events that are equal in all else
    sliced = stored(events.repartitionByRange(*order).withColumn("__slice", F.spark_partition_id()), "sessions")
    place = F.struct(*names, "__ts")
    earlier = Window.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)

    def carried(per_slice):
        """Of each slice the last ``x`` of the slices before it: as many rows as partitions."""
        return F.broadcast(per_slice.select(F.col("__slice").alias("__at"), F.last("x", ignorenulls=True).over(earlier).alias("__before")))

    within = Window.partitionBy("__slice").orderBy(*order)
    last_events = carried(sliced.groupBy("__slice").agg(F.max(place).alias("x")))
    placed = sliced.withColumn("__own", F.lag(place).over(within)).join(last_events, F.col("__slice") == F.col("__at")).withColumn(
        "__prev", F.coalesce("__own", "__before"))
    goes_on = all_of([F.col(n).eqNullSafe(F.col(f"__prev.{n}")) for n in names]) & (F.col("__ts") <= F.col("__prev.__ts") + gap_expr)
    started = F.last(F.when(F.col("__prev").isNull() | ~goes_on, F.col("__ts")), ignorenulls=True).over(
        within.rowsBetween(Window.unboundedPreceding, 0))
    parts = stored(placed.withColumn("__start", started).groupBy("__slice", *names, "__start").agg(
        F.max("__ts").alias("__last"), F.count("*").alias("__n"), F.sum("__v").alias("__total")), "sessions-parts")
    # events before a slice's first start belong to the session that started last before the slice
    last_starts = carried(parts.groupBy("__slice").agg(F.max(F.when(F.col("__start").isNotNull(), F.struct(*names, "__start"))).alias("x")))
    whole = parts.join(last_starts, F.col("__slice") == F.col("__at")).withColumn(
        "__start", F.coalesce("__start", "__before.__start"))
    sessions = whole.groupBy(*names, "__start").agg(F.max("__last").alias("__last"), F.sum("__n").alias("__n"),
                                                    F.sum("__total").alias("__total"))
    out = [F.col(n).alias(k) for n, k in zip(names, keys)] + [
        F.col("__start").alias("window_start"), (F.col("__last") + gap_expr).alias("window_end"), F.col("__n").alias("n")]
    return sessions.select(*out, *([F.col("__total").alias("total")] if value is not None else []))
