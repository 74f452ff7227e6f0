"""Rows of a stream in event-time order: a buffer per key that timers release once the watermark has passed.

State lives in maps of the state store, so a batch touches the rows that arrive and those that are released; of the others only those
that share a chunk with released ones are written again.
Rows behind the watermark are dropped and counted by Spark (`late_rows`). The state store must be the RocksDB one; the functions here
choose it for streams that start later in the session.
"""

from __future__ import annotations

import pickle
from bisect import bisect_right
from collections.abc import Callable, Iterator
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHUNK = 2048  # rows that wait together
RUN = 65_536  # rows of a key and batch that are sorted at once
EPOCH = datetime(1970, 1, 1, tzinfo=UTC)


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def _place(row: tuple) -> list:
    """Rows by time, then by all their values, unknown ones first."""
    return [(x is not None, x) for x in row]


def moment(us: int) -> datetime:
    return EPOCH + timedelta(microseconds=us)


class InOrder(StatefulProcessor):
    """Hands the rows of a key to `step(key, carried, row) -> (carried, output rows)` by event time, then by all their values.

    `row` is a tuple, its first field the event time in microseconds. Waiting rows lie in a map as sorted chunks, so the calls to the state
    store grow with the keys and chunks of a batch and not with its rows. A batch reads the chunks that begin before the watermark and
    writes what it keeps of them; a key's chunks are read in order of their first row, and no more are held than overlap in time."""

    def __init__(self, step: Callable):
        self.step = step

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "first long, number long", "rows binary")
        self.kept = handle.getValueState("kept", "alarm long, chunks long, carried binary")  # the timer, chunks numbered so far, what the steps carry

    def store(self, rows: list, number: int) -> int:
        """Puts rows away as sorted chunks numbered from `number`; returns the next number."""
        rows.sort(key=_place)
        for i in range(0, len(rows), CHUNK):
            some = rows[i : i + CHUNK]
            self.waiting.updateValue((some[0][0], number), (pickle.dumps(some),))
            number += 1
        return number

    def wake(self, ms: int, now: int, before: int | None) -> int:
        """One timer a key: when the watermark passes the earliest row that waits. Returns when that is."""
        ms = max(ms, now + 1)
        if before is not None and now < before <= ms:
            return before
        if before is not None and before > now:
            self.handle.deleteTimer(before)
        self.handle.registerTimer(ms)
        return ms

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        alarm, number, carried = self.kept.get() or (None, 0, None)
        at, earliest, fresh = None, None, []
        for row in rows:
            at = at or [i for i, c in enumerate(row.__fields__) if c.startswith("_")]
            values = tuple(row)
            fresh.append(tuple(values[i] for i in at))
            if len(fresh) >= RUN:
                earliest = min(r[0] for r in fresh) if earliest is None else min(earliest, *(r[0] for r in fresh))
                number, fresh = self.store(fresh, number), []
        if fresh:
            earliest = min([r[0] for r in fresh] + ([] if earliest is None else [earliest]))
            number = self.store(fresh, number)
        if earliest is not None:
            alarm = self.wake(earliest // 1000, timerValues.getCurrentWatermarkInMs(), alarm)
            self.kept.update((alarm, number, carried))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        _, number, carried = self.kept.get() or (None, 0, None)
        carried = None if carried is None else pickle.loads(carried)
        chunks = sorted(tuple(k) for k in self.waiting.keys())  # noqa: SIM118
        due = [c for c in chunks if c[0] <= now * 1000]
        later = chunks[len(due)][0] if len(due) < len(chunks) else None
        held: list = []
        for i, chunk in enumerate(due):
            held += pickle.loads(self.waiting.getValue(chunk)[0])
            self.waiting.removeKey(chunk)
            held.sort(key=_place)
            upto = min(now * 1000, due[i + 1][0] - 1) if i + 1 < len(due) else now * 1000  # rows that no further chunk comes before
            n = bisect_right(held, upto, key=lambda r: r[0])
            for row in held[:n]:
                carried, out = self.step(key, carried, row)
                yield from out
            held = held[n:]
        if held:
            later = held[0][0] if later is None else min(later, held[0][0])
            number = self.store(held, number)
        alarm = None if later is None else self.wake(later // 1000, now, None)
        self.kept.update((alarm, number, None if carried is None else pickle.dumps(carried)))

    def close(self) -> None:
        pass


def in_order(df: DataFrame, keys: list[str], at: str, delay: str, values: dict[str, str], step: Callable, schema: str) -> DataFrame:
    """`step` over the rows of each key in the order of `at`, once the watermark (`delay` behind the latest row) has passed them.

    `values`: the columns a step sees after the time, and their types. Rows without a time cannot be placed and are left out.
    """
    use_rocksdb(df.sparkSession)
    rows = df.where(F.col(at).isNotNull()).withWatermark(at, delay)
    rows = rows.select(*keys, at, F.unix_micros(at).alias("_us"), *[F.col(c).cast(t).alias(f"_{c}") for c, t in values.items()])
    return rows.groupBy(*keys).transformWithState(InOrder(step), schema, "append", "EventTime")
