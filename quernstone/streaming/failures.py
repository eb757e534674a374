"""Failure streaks in a stream: told of once, recovered from once, forgotten after a while."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATE = "failures int, last timestamp"
EPOCH, MICRO = dt.datetime(1970, 1, 1), dt.timedelta(microseconds=1)


class Streaks(StatefulProcessor):
    """A typed value for each source: how often it has failed in a row, and when it did last.

    A timer clears the state of a source that has not failed for ``hours``; a row that comes
    before the timer has fired finds the state too old by its own time, so what is told does not
    depend on when batches end.
    """

    def __init__(self, key: str, order: str, threshold: int, hours: float):
        self.key, self.order, self.threshold, self.kept = key, order, threshold, dt.timedelta(hours=hours)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.streak = handle.getValueState("streak", STATE)

    def expiry(self, last: dt.datetime) -> int:
        return int((last + self.kept).timestamp() * 1000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        """Each call of the state is a message to the executor: a source that fails neither before nor at the end of its rows costs one."""
        parts = list(rows)
        batch = parts[0] if len(parts) == 1 else pd.concat(parts)
        at, number, bad = batch["ts"].to_numpy("datetime64[us]").astype("int64"), batch[self.order].to_numpy(), batch["bad"].to_numpy()
        place = np.lexsort((number, at))
        before = self.streak.get()
        failures, last = (before[0], (before[1] - EPOCH) // MICRO) if before else (0, None)
        kept, told = self.kept // MICRO, []
        for t, n, failed in zip(at[place].tolist(), number[place].tolist(), bad[place].tolist()):
            if last is not None and t - last > kept:
                failures, last = 0, None
            if failed:
                failures, last = failures + 1, t
                if failures == self.threshold:
                    told.append((n, key[0], "alert", failures))
            else:
                if failures >= self.threshold:
                    told.append((n, key[0], "recovered", failures))
                failures, last = 0, None
        after = (failures, EPOCH + last * MICRO) if failures else None
        if after != (before and tuple(before)):
            if before:
                self.handle.deleteTimer(self.expiry(before[1]))
            if after:
                self.streak.update(after)
                self.handle.registerTimer(self.expiry(after[1]))
            else:
                self.streak.clear()
        if told:
            yield pd.DataFrame(told, columns=[self.order, self.key, "told", "streak"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.streak.clear()
        yield from ()


def failure_states(rows: DataFrame, key: str, order: str, threshold: int = 2, hours: float = 24, delay: str = "1 hour") -> DataFrame:
    """(``order``, ``key``, told, streak) of a stream (``key``, ``order``, ts, bad): "alert" at the ``threshold``-th failure in a row, "recovered" at the success that ends such a streak.

    A streak is forgotten ``hours`` after its last failure. Start the query inside ``engine.rocksdb``.
    """
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = f"`{order}` {kinds[order]}, `{key}` {kinds[key]}, told string, streak int"
    timed = rows.select(key, order, "ts", F.col("bad")).withWatermark("ts", delay)
    return timed.groupBy(key).transformWithStateInPandas(Streaks(key, order, threshold, hours), schema, "Append", "EventTime")
