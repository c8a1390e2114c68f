"""Jobs that fall silent, as a stream with timers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Timers and typed state need a store that keeps them apart by column family.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Silence(StatefulProcessor):
    """The unsettled signs of life of a job as one value, and one timer for the earliest of them.

    When it rings, all rows up to that time are there, and every sign that the watermark has passed is settled at once.
    """

    def __init__(self, keys: list[str], idle_ms: int):
        self.keys, self.idle = keys, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # Sorted times, then for each whether it ended the job, both as int64.
        self.signs = handle.getValueState("signs", "packed binary")

    def _load(self) -> tuple[np.ndarray, np.ndarray]:
        known = self.signs.get()
        at, ended = np.frombuffer(known[0], dtype="<i8").reshape(2, -1) if known is not None else np.empty((2, 0), dtype="<i8")
        return at, ended

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts = [p for p in rows if not p.empty]  # a micro-batch without rows only moves the watermark
        if parts:
            at, ended = self._load()
            soonest = at[0] if len(at) else None
            every = np.concatenate([at, *(p["sign_at"].to_numpy().astype("<i8") for p in parts)])
            flags = np.concatenate([ended, *(p["sign_ended"].to_numpy().astype("<i8") for p in parts)])
            times, place = np.unique(every, return_inverse=True)
            merged = np.zeros(len(times), dtype="<i8")
            np.maximum.at(merged, place, flags)
            self.signs.update((np.stack([times, merged]).tobytes(),))
            if soonest is None or times[0] < soonest:
                self.handle.registerTimer(int(times[0]) + self.idle)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at, ended = self._load()
        rung = expiredTimerInfo.getExpiryTimeInMs()
        due = int(np.searchsorted(at, max(rung + 1, timerValues.getCurrentWatermarkInMs()) - self.idle))
        if due == 0:  # settled by a later-set timer
            return
        later = np.zeros(due, dtype=bool)
        gaps = np.diff(at[:due + 1]) <= self.idle  # the last sign of all has none after it
        later[:len(gaps)] = gaps
        if due < len(at):
            self.signs.update((np.stack([at[due:], ended[due:]]).tobytes(),))
            self.handle.registerTimer(int(at[due]) + self.idle)
        else:
            self.signs.clear()
        last = at[:due][(ended[:due] == 0) & ~later]
        if len(last):
            yield pd.DataFrame({**{k: [v] * len(last) for k, v in zip(self.keys, key)}, "last_seen": last, "stale_at": last + self.idle})

    def close(self) -> None:
        pass


def stale_jobs(events: DataFrame, keys: list[str], ts: str, ended: Column, idle: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """(keys, last_seen, stale_at): one row ``idle`` after a job's last sign of life, unless that ended it or another came in time.

    ``events`` is a stream; rows may come late by ``lateness``, and a row counts wherever it falls, since a timer rings
    only when the watermark has passed it.  Only keys, times and one flag go to Python.  State per job: its signs of
    life of the last ``idle`` + ``lateness``, read and written once per micro-batch.  Needs the state store of ``STORE``.
    """
    kinds = dict(events.dtypes)
    # The names that reach Python must not begin with an underscore.
    slim = events.select(*keys, F.col(ts).cast("timestamp").alias("_ts"), F.coalesce(ended, F.lit(False)).alias("sign_ended")).withWatermark("_ts", lateness)
    slim = slim.filter(F.col("_ts").isNotNull()).withColumn("sign_at", F.unix_millis("_ts"))
    out = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", last_seen long, stale_at long"
    found = slim.groupBy(*keys).transformWithStateInPandas(
        _Silence(keys, int(pd.Timedelta(idle).total_seconds() * 1000)), outputStructType=out, outputMode="Append", timeMode="EventTime")
    return found.select(*keys, *[F.timestamp_millis(c).alias(c) for c in ("last_seen", "stale_at")])
