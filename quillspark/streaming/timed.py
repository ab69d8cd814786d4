"""Requests judged in the order of their time, across micro-batches, on state with event-time timers.

A key's rows are sorted in runs of bounded size, and each run waits in the state as pieces of a few
hundred rows. When the watermark passes a key's earliest row, a timer merges what is due of all runs, holding
one piece of each, and hands it row by row to a small step function, which keeps one value for each key.
So late rows are taken where they belong, a hot key is never gathered in Python, and a key costs a few calls
on the state for each piece, not for each row. A row is answered once the watermark is past it.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Callable, Iterator
from contextlib import AbstractContextManager
from itertools import islice

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quillspark.functions import patterns as P
from quillspark.streaming.streams import limit_rows, reuse_rows, session_settings

SETTING, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Rows of a key that are sorted at once, and rows of a piece in the state.
RUN, PIECE = 50_000, 512


def timed_state(spark: SparkSession) -> AbstractContextManager[None]:
    """Streams started inside keep their state in RocksDB, which timers and typed state need."""
    return session_settings(spark, {SETTING: ROCKS})


class InOrder(StatefulProcessor):
    """Calls ``step(kept, ms, value)`` for each row in the order of time and event; it gives the output's values and what to keep.

    What is kept of a key is cleared ``idle_ms`` after its last row.
    """

    def __init__(self, step: Callable, value: str, kept: str, names: list[str], idle_ms: int) -> None:
        self.step, self.value, self.kept, self.names, self.idle = step, value, kept, names, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "first long, run long, part long", f"times array<long>, events array<long>, items array<{self.value}>")
        self.state = handle.getValueState("kept", f"last long, {self.kept}")
        self.runs = handle.getValueState("runs", "n long")

    def _put(self, run: int, part: int, rows: list[tuple]) -> None:
        times, events, items = zip(*rows, strict=True)
        self.waiting.updateValue((times[0], run, part), (list(times), list(events), list(items)))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        each, n, first = ((r["ms"], r["event_id"], r["value"]) for r in rows), self.runs.get()[0] if self.runs.exists() else 0, None
        while run := sorted(islice(each, RUN), key=lambda r: r[:2]):
            for part in range(0, len(run), PIECE):
                self._put(n, part, run[part : part + PIECE])
            n, first = n + 1, run[0][0] if first is None else min(first, run[0][0])
        self.runs.update((n,))
        if first is not None:
            self.handle.registerTimer(first + 1)
        return iter(())

    def _due(self, pieces: list[tuple], until: int) -> Iterator[tuple]:
        """A run's rows before ``until``, piece by piece; what a piece holds beyond stays."""
        for at in sorted(pieces):
            rows = list(zip(*self.waiting.getValue(at), strict=True))
            self.waiting.removeKey(at)
            for i, r in enumerate(rows):
                if r[0] >= until:
                    self._put(at[1], at[2], rows[i:])
                    break
                yield r

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        until, now = timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()
        last, *kept = self.state.get() if self.state.exists() else (0,)
        runs = defaultdict(list)
        for first, run, part in self.waiting.keys():
            if first < until:
                runs[run].append((first, run, part))
        if not runs:
            if kept and now >= last + self.idle:
                self.state.clear()
            return
        kept = tuple(kept) or None
        for ms, event, item in heapq.merge(*[self._due(p, until) for p in runs.values()], key=lambda r: r[:2]):
            out, kept = self.step(kept, ms, item)
            last = ms
            yield Row(**dict(zip(self.names, (key[0], event, *out), strict=True)))
        self.state.update((last, *kept))
        self.handle.registerTimer(last + self.idle)
        left = min((first for first, _, _ in self.waiting.keys()), default=None)
        if left is not None:
            self.handle.registerTimer(left + 1)
        else:
            self.runs.clear()

    def close(self) -> None:
        pass


def _in_order(stream: DataFrame, key: str, value: str, step: Callable, kept: str, out: list[T.StructField], idle_ms: int) -> DataFrame:
    rows = stream.select(F.col(key).alias("key"), "event_id", "ts", F.unix_millis("ts").alias("ms"), F.col(value).alias("value"))
    schema = T.StructType([T.StructField(key, stream.schema[key].dataType), T.StructField("event_id", T.LongType()), *out])
    return rows.groupBy("key").transformWithState(InOrder(step, dict(stream.dtypes)[value], kept, schema.fieldNames(), idle_ms), schema, "append", "eventTime")


def timed_rate_limit(stream: DataFrame, key: str, period_s: int = P.PERIOD_SECONDS) -> DataFrame:
    """key, event_id, allowed, retry_after_s of stream(key, event_id, ts, limit); see ``streams.rate_limit``."""
    period = period_s * 1000

    def step(kept, ms, limit):
        (out,), count, reset = limit_rows([ms], [limit], *(kept or (0, 0)), period)
        return out, (count, reset)

    out = [T.StructField("allowed", T.BooleanType()), T.StructField("retry_after_s", T.LongType())]
    return _in_order(stream, key, "limit", step, "count long, reset long", out, period)


def timed_reuse(stream: DataFrame, key: str, ttl_s: int) -> DataFrame:
    """key, event_id, outcome of stream(key, event_id, ts, no_store); see ``streams.reuse_within_ttl``."""
    ttl = ttl_s * 1000

    def step(kept, ms, skip):
        out, stored = reuse_rows([ms], [skip], kept[0] if kept else -1, ttl)
        return out, (stored,)

    return _in_order(stream, key, "no_store", step, "stored long", [T.StructField("outcome", T.StringType())], ttl)


def timed_repeats(stream: DataFrame, key: str, output: str, idle_ms: int = 30 * 86_400_000) -> DataFrame:
    """key, event_id, nth, same_as_previous; see ``streams.repeat_tracker``."""

    def step(kept, ms, value):
        n, last = kept or (0, None)
        return (n + 1, None if n == 0 else value == last), (n + 1, value)

    out = [T.StructField("nth", T.LongType()), T.StructField("same_as_previous", T.BooleanType())]
    return _in_order(stream, key, output, step, f"n long, value {dict(stream.dtypes)[output]}", out, idle_ms)
