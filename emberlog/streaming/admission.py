"""Rate limits, quotas and retries on streams, decided in order of time as the batch queries decide them.

Rows of a key wait in its state until the watermark has passed them, and are then decided in order, ties as in a batch.
What is kept of a key beside them is forgotten once it says no more than a new one would: a bucket that is full again, a
quota whose day is over, a batch id seen longer ago than a retry may be. Rows later than the watermark are left out.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from emberlog.operators.admission import Bucket
from emberlog.operators.paging import ties

DAY = 86400


class Limits:
    """`quota_flags` of one key, row by row. held: what a state keeps."""

    def __init__(self, rate: float | None, burst: float | None, max_bytes: int | None, max_events: int | None):
        self.bucket = Bucket(rate, burst) if rate is not None else None
        self.limits, self.held = (max_bytes, max_events), [None, None, None, 0, 0]  # of the bucket: left, last; day, events, bytes

    def take(self, t: float, events: int, size: int) -> str | None:
        left, last, day, n, held = self.held
        if day != t // DAY:
            day, n, held = t // DAY, 0, 0
        refused = None
        if self.bucket is not None:
            self.bucket.left, self.bucket.last = self.bucket.burst if left is None else left, last
            refused = None if self.bucket.take(t) else "rate"
            left, last = self.bucket.left, self.bucket.last
        if refused is None:
            most, count = self.limits
            refused = "bytes" if most is not None and held + size > most else "events" if count is not None and n + events > count else None
        if refused is None:
            n, held = n + events, held + size
        self.held = [left, last, day, n, held]
        return refused

    def until(self) -> float:
        """The time from which on a new one is as good."""
        left, last, day, _, _ = self.held
        full = last + (self.bucket.burst - left) / self.bucket.rate if self.bucket is not None and last is not None and self.bucket.rate > 0 else 0.0
        over = (day + 1) * DAY if any(x is not None for x in self.limits) else 0.0
        return max(full, over)


class Retries:
    """`retried` of one batch id, row by row."""

    def __init__(self, minutes: int):
        self.seconds, self.held = 60 * minutes, None

    def take(self, t: float, events: int, size: int) -> bool:
        again = self.held is not None and t < self.held + self.seconds
        self.held = self.held if again else t
        return again

    def until(self) -> float:
        return self.held + self.seconds


class _InOrder(StatefulProcessor):
    """A key's rows that wait, [micros, ties, events, bytes, row], and what is held of it."""

    def __init__(self, make: Callable[[], Limits | Retries], column: str):
        self.make, self.column = make, column

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("key", "rows string, held string")

    def load(self) -> tuple[list, Any]:
        found = self.state.get()
        return (json.loads(found[0]), json.loads(found[1])) if found is not None else ([], None)

    def due(self, rows: list, held: Any) -> int | None:
        """The time of a state's only timer, which follows from the state, so that timers needn't be listed."""
        if rows:
            return min(r[0] for r in rows) // 1000 + 1
        if held is None:
            return None
        fold = self.make()
        fold.held = held
        return int(fold.until() * 1000) + 1

    def save(self, rows: list, held: Any, before: int | None) -> None:
        """before: the timer that is set, if one is."""
        due = self.due(rows, held)
        if due is None:
            self.state.clear()
        else:
            self.state.update((json.dumps(rows), json.dumps(held)))
        if due != before:
            if before is not None:
                self.handle.deleteTimer(before)
            if due is not None:
                self.handle.registerTimer(due)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802
        waiting, held = self.load()
        before = self.due(waiting, held)
        for pdf in rows:
            for t, tie, events, size, row in zip(pdf["micros"], pdf["ties"], pdf["events"], pdf["bytes"], pdf["row"], strict=True):
                waiting.append([int(t), [[v is not None, v if v is not None else 0] for v in json.loads(tie).values()], int(events), int(size), row])
        self.save(waiting, held, before)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802
        waiting, held = self.load()
        now = timerValues.getCurrentWatermarkInMs() * 1000
        fold, out = self.make(), []
        if held is not None:
            fold.held = held
        for t, _, events, size, row in sorted((r for r in waiting if r[0] < now), key=lambda r: r[:2]):
            out.append((row, fold.take(t / 1e6, events, size)))
            held = fold.held
        until = fold.until() if held is not None else 0.0
        waiting = [r for r in waiting if r[0] >= now]
        self.save(waiting, None if held is not None and until * 1e6 < now else held, None)  # the timer that expired is gone
        if out:
            yield pd.DataFrame({"row": [r for r, _ in out], self.column: [x for _, x in out]})

    def close(self) -> None:
        pass


def _decided(stream: DataFrame, make: Callable[[], Limits | Retries], column: str, kind: T.DataType, watermark: str) -> DataFrame:
    """stream (key, ts, ...) with a column that `make` decides. Start it within `rules.store`."""
    names = [f.name for f in stream.schema]
    number = lambda c: F.col(c).cast("long") if c in names else F.lit(1 if c == "events" else 0).cast("long")
    tie = F.to_json(F.struct(*[c.alias(f"c{k}") for k, c in enumerate(ties(stream, "key", "ts"))]) if ties(stream, "key", "ts") else F.struct(F.lit(0).alias("c0")), {"ignoreNullFields": "false"})
    whole = F.to_json(F.struct(*[F.col(f"`{n}`") for n in names]), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"})
    packed = stream.withWatermark("ts", watermark).select("key", "ts", F.unix_micros("ts").alias("micros"), tie.alias("ties"), F.coalesce(number("events"), F.lit(0)).alias("events"), F.coalesce(number("bytes"), F.lit(0)).alias("bytes"), whole.alias("row"))
    schema = T.StructType([T.StructField("row", T.StringType()), T.StructField(column, kind)])
    out = packed.groupBy("key").transformWithStateInPandas(_InOrder(make, column), schema, "append", "eventTime")
    fields = F.from_json("row", stream.schema, {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"})
    return out.select(fields.alias("r"), column).select("r.*", column)


def token_bucket_stream(requests: DataFrame, rate: float, burst: float | None = None, watermark: str = "10 minutes") -> DataFrame:
    """`token_bucket` on a stream of (key, ts, ...)."""
    out = _decided(requests, lambda: Limits(rate, burst, None, None), "refused", T.StringType(), watermark)
    return out.withColumn("allowed", F.col("refused").isNull()).drop("refused")


def quota_stream(requests: DataFrame, *, rate: float | None = None, burst: float | None = None, max_bytes: int | None = None, max_events: int | None = None, watermark: str = "10 minutes") -> DataFrame:
    """`quota_flags` on a stream of (key, ts, events, bytes, ...)."""
    return _decided(requests, lambda: Limits(rate, burst, max_bytes, max_events), "refused", T.StringType(), watermark)


def retried_stream(batches: DataFrame, minutes: int = 10, watermark: str = "10 minutes") -> DataFrame:
    """`retried` on a stream of (batch_id, ts, ...); null and empty ids are never retries, and don't wait."""
    named = F.coalesce(F.col("batch_id") != "", F.lit(False))
    found = _decided(batches.where(named).withColumn("key", F.col("batch_id")), lambda: Retries(minutes), "duplicate", T.BooleanType(), watermark).drop("key")
    return found.unionByName(batches.where(~named).withColumn("duplicate", F.lit(False)))
