"""Increments of cumulative readings as a stream, with the last good reading of each key as state that ends.

The fold is that of ``operators.folds.hold_last_good``, a reading at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators.folds import LastGood

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FOLD = "last double, seen boolean"


class _Held(StatefulProcessor):
    def __init__(self, key: str, order: str, value: str, silent_ms: int | None):
        self.key, self.order, self.value, self.silent = key, order, value, silent_ms

    def increments(self, key: tuple, readings: list[tuple[Any, float | None]]) -> pd.DataFrame:
        """Folds readings that are in order into the state."""
        fold = LastGood(*(self.fold.get() if self.fold.exists() else ()))
        rows = [(key[0], at, fold.step(v)) for at, v in readings]
        self.fold.update((fold.last, fold.seen))
        return pd.DataFrame(rows, columns=[self.key, self.order, "increment"])

    def read(self, rows: Iterator[pd.DataFrame]) -> list[tuple[Any, float | None]]:
        known = pd.concat(list(rows)).dropna(subset=[self.order])
        return [(at, None if v != v else float(v)) for at, v in zip(known[self.order], known[self.value].astype("float64"), strict=True)]

    @staticmethod
    def in_order(readings: list[tuple]) -> list[tuple]:
        """By time, then value, the unknown first."""
        return sorted(readings, key=lambda r: (r[0], r[1] is not None, r[1] or 0.0))

    def close(self) -> None:
        pass


class HeldAtOnce(_Held):
    """Folds what a trigger brings at once; state ends when a key has been silent for so long by the clock (TTL), if told."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.fold = handle.getValueState("fold", FOLD, ttlDurationMs=self.silent)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        yield self.increments(key, self.in_order(self.read(rows)))


class HeldInOrder(_Held):
    """Folds readings in order of event time, once the watermark has passed them; until then they wait as a list.

    A key has one timer: at its earliest waiting reading, or, when none waits, at the end of its silence, which ends its state.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.fold = handle.getValueState("fold", FOLD)
        self.waiting = handle.getListState("waiting", "at long, value double")
        self.clock = handle.getValueState("clock", "timer long, newest long")

    def wait(self, timer: int, newest: int) -> None:
        """Moves the timer (milliseconds)."""
        if self.clock.exists() and self.clock.get()[0] != timer:
            self.handle.deleteTimer(self.clock.get()[0])
        self.handle.registerTimer(timer)
        self.clock.update((timer, newest))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        new = [(int(at.value) // 1000, v) for at, v in self.read(rows)]
        if new:
            had = self.waiting.exists()
            self.waiting.appendList(new)
            first, newest = -(-min(at for at, _ in new) // 1000), max(at for at, _ in new)
            if self.clock.exists():
                timer, before = self.clock.get()
                first, newest = min(first, timer) if had else first, max(newest, before)
            self.wait(first, newest)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = self.in_order([tuple(r) for r in self.waiting.get()]) if self.waiting.exists() else []
        _, newest = self.clock.get()
        self.clock.clear()  # this timer is over
        if not waiting:
            self.fold.clear()
            return
        due, rest = [r for r in waiting if r[0] <= now], [r for r in waiting if r[0] > now]
        self.waiting.clear()
        if rest:
            self.waiting.appendList(rest)
        self.wait(-(-rest[0][0] // 1000) if rest else newest // 1000 + self.silent, newest)
        if due:
            yield self.increments(key, [(pd.Timestamp(at, unit="us"), v) for at, v in due])


def held_increments(stream: DataFrame, key: str, order: str, value: str, *, late: str | None = None, silent: str | None = None) -> DataFrame:
    """(key, order, increment) of cumulative readings; suspect drops are passed over as in the batch fold.

    With ``late``, ``order`` is the event time: readings that come late within it are folded in their place, and the rows are
    those of the batch fold, given out when the watermark has passed them.  A key whose newest reading lies ``silent`` (90 days)
    behind the watermark loses its state.  Without ``late`` each trigger's readings are folded at once in order; state ends
    ``silent`` after a key's last reading by the clock, and never without it.  By the clock a stream always has another batch to
    run, so it is for triggers that go on, not for ``availableNow``.  A key that speaks again starts anew.  Readings without
    an order are left out.  The session's states are kept in RocksDB from then on, as such state needs it.
    """
    stream.sparkSession.conf.set(PROVIDER, ROCKSDB)
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema}
    made = HeldInOrder if late else HeldAtOnce
    rows = (stream.withWatermark(order, late) if late else stream).select(key, order, value)
    silent = silent or ("90 days" if late else None)
    processor = made(key, order, value, silent and int(pd.Timedelta(silent).total_seconds() * 1000))
    mode = "EventTime" if late else "ProcessingTime" if silent else "None"
    return rows.groupBy(key).transformWithStateInPandas(processor, f"{key} {kinds[key]}, {order} {kinds[order]}, increment double", "append", mode)
