"""Service health as a stream: the transitions between running, no_listener and absent.

A host is seen by observations: its process (a row of a process listing) or, more, its listening socket. It is
``running`` from a listener's observation until ``quiet`` has passed without another, ``no_listener`` while
anything was seen within ``gone``, and ``absent`` before and after. An observation at the very end of such a time still
extends it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from basin.streaming.windows import event_time

ABSENT, NO_LISTENER, RUNNING = "absent", "no_listener", "running"

#: Rows of a group that may wait, besides as many as its state has, before they are merged into it.
MERGE_ROWS = 50_000


class HostHealth(StatefulProcessor):
    """Per group of hosts: the spans of time in which each was seen, and heard, as far as the watermark has not passed them.

    A span goes from an observation to the last one that follows without a gap of more than ``gone`` (seen) or
    ``quiet`` (heard), so it does not matter in which order they arrive; every change of state is the start or the
    end of a span. A timer wakes the group when the watermark passes the first change that has not come out; spans whose
    end has passed go, so state is bounded by the hosts seen within lateness and ``gone``. A call to the state takes
    about a millisecond: a group makes a few for all its hosts, where a group of one host would make them for each.
    """

    def __init__(self, quiet_us: int, gone_us: int):
        self.quiet, self.gone = quiet_us, gone_us

    def init(self, handle) -> None:
        self.handle = handle
        # spans: an Arrow table; told: changes up to this time have come out; wake: the group's only timer
        self.known = handle.getValueState("known", "spans binary, told bigint, wake bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        spans, told, wake = self._load()
        first, new, waiting = None, [], 0
        for df in rows:
            at = df["at"].to_numpy()
            first = int(at.min()) if first is None else min(first, int(at.min()))
            seen = pd.DataFrame({"host": df["host"], "heard": False, "first": at, "last": at})
            new += [seen, seen[df["listens"].to_numpy(bool)].assign(heard=True)]
            waiting += len(df)
            if waiting > MERGE_ROWS + len(spans):
                spans, new, waiting = self._merged([spans, *new]), [], 0
        spans = self._merged([spans, *new])
        self.known.update((_packed(spans), told, self._wake(first, wake)))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = timerValues.getCurrentWatermarkInMs() * 1000
        spans, told, wake = self._load()
        heard, first, last = (spans[c].to_numpy() for c in ("heard", "first", "last"))
        end = last + np.where(heard, self.quiet, self.gone)
        # spans are in the order of host, first, heard: a span heard lies in the last span seen before it
        within = np.maximum.accumulate(np.where(heard, 0, np.arange(len(spans))))
        starts_heard = np.zeros(len(spans), bool)
        starts_heard[within[heard & (first == first[within])]] = True
        changes = pd.concat([
            pd.DataFrame({"host": spans["host"], "at": first, "state": np.where(heard, RUNNING, NO_LISTENER)})[heard | ~starts_heard],
            pd.DataFrame({"host": spans["host"], "at": end, "state": np.where(heard, NO_LISTENER, ABSENT)})[~heard | (end < end[within])],
        ])
        at = changes["at"].to_numpy()
        later = at[at > upto]
        if wake is not None and wake == expiredTimerInfo.getExpiryTimeInMs():
            wake = None  # Spark takes the timer away after this call
        if len(later):
            self.known.update((_packed(spans[end > upto]), upto, self._wake(int(later.min()), wake)))
        else:
            self.known.clear()
        due = changes[(at <= upto) & (at > told if told is not None else True)]
        if len(due):
            yield due

    def close(self) -> None:
        pass

    def _load(self):
        known = self.known.get()
        if known is None:
            return pd.DataFrame({"host": [], "heard": np.array([], bool), "first": np.array([], "int64"), "last": np.array([], "int64")}), None, None
        spans, told, wake = known
        return pa.ipc.open_stream(bytes(spans)).read_pandas(), told, wake

    def _wake(self, at_us: int, wake: int | None) -> int:
        """Ask for a call once the watermark has passed ``at_us`` (timers count milliseconds), or ``wake`` if that is earlier."""
        at = -(-at_us // 1000)
        if wake is not None and wake <= at:
            return wake
        if wake is not None:
            self.handle.deleteTimer(wake)
        self.handle.registerTimer(at)
        return at

    def _merged(self, parts: list[pd.DataFrame]) -> pd.DataFrame:
        """Spans of a host that meet, or lie no further apart than ``gone`` (seen) or ``quiet`` (heard), as one."""
        spans = pd.concat([p for p in parts if len(p)], ignore_index=True)
        heard, first = spans["heard"].to_numpy(), spans["first"].to_numpy()
        key = 2 * pd.factorize(spans["host"], use_na_sentinel=False)[0] + heard
        order = np.lexsort((first, key))
        key, first, last = key[order], first[order], spans["last"].to_numpy()[order]
        reach = pd.Series(last).groupby(key).cummax().to_numpy()
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (first[1:] > reach[:-1] + np.where(key[1:] % 2 == 1, self.quiet, self.gone))
        at = np.flatnonzero(new)
        out = pd.DataFrame({"host": spans["host"].to_numpy()[order[at]], "heard": key[at] % 2 == 1, "first": first[at],
                            "last": np.maximum.reduceat(last, at)})
        return out.iloc[np.lexsort((out["heard"], out["first"], key[at] // 2))]


def _packed(spans: pd.DataFrame) -> bytes:
    table = pa.Table.from_pandas(spans, preserve_index=False).replace_schema_metadata(None)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def health_transitions(observations: DataFrame, host: str, ts: str, listens: str, quiet: str, gone: str,
                       lateness: str, groups: int = 256) -> DataFrame:
    """(host, at, state): every change of state of every host, from a stream of observations.

    ``listens`` is a boolean column: the observation is of the listening socket. ``quiet`` and ``gone`` are
    intervals, ``quiet`` no longer than ``gone``. Observations with equal host and time count as one; rows with a NULL host
    or time are ignored, a NULL ``listens`` is false. Rows later than ``lateness`` behind the newest are dropped. A change comes out when the
    watermark has passed its time, so the order of arrival does not matter within the lateness. Start the result in
    append mode; the state store must be RocksDB.

    Hosts share state in ``groups`` groups by a hash, fixed with the checkpoint: some thousand hosts a group, and many groups a
    state partition. A micro-batch reads and writes the state of the groups it has rows of.
    """
    if not observations.isStreaming:
        raise ValueError("health_transitions reads a stream")
    us = lambda text: observations.sparkSession.sql(f"SELECT unix_micros(timestamp_micros(0) + INTERVAL {text}) AS us").first().us
    quiet_us, gone_us = us(quiet), us(gone)
    if not 0 < quiet_us <= gone_us:
        raise ValueError("quiet must be positive and no longer than gone")
    kind = observations.schema[host].dataType
    # as pandas holds them whole; others go through text
    plain = isinstance(kind, (T.IntegralType, T.StringType, T.BinaryType, T.BooleanType))
    seen = event_time(observations, ts).select(
        (F.col(host) if plain else F.col(host).cast("string")).alias("host"), F.col(ts).alias("__ts"),
        F.coalesce(F.col(listens), F.lit(False)).alias("listens")).where("host IS NOT NULL AND __ts IS NOT NULL")
    marked = seen.select(
        F.pmod(F.xxhash64("host"), F.lit(groups)).alias("group"), "host", F.unix_micros("__ts").alias("at"), "listens",
        F.least("__ts", F.timestamp_seconds(F.lit(9_200_000_000))).alias("__ts"))  # pandas holds times up to 2262
    text = kind.simpleString() if plain else "string"
    out = marked.withWatermark("__ts", lateness).groupBy("group").transformWithStateInPandas(
        HostHealth(quiet_us, gone_us), f"host {text}, at bigint, state string", "append", "eventTime")
    at = F.timestamp_micros("at")
    ntz = observations.schema[ts].dataType.simpleString() == "timestamp_ntz"
    return out.select((F.col("host") if plain else F.col("host").cast(kind)).alias(host),
                      (at.cast("timestamp_ntz") if ntz else at).alias("at"), "state")
