"""Rate limits and daily quotas over a log of requests.

The decisions of a key depend on each other, so its requests are folded in order of time: rows are dealt out by key
and sorted, and pass through a task in batches, of which only the state of the current key is held.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlog.operators.paging import ties


class Bucket:
    """A token bucket: `rate` tokens a second up to `burst`; a refused request takes none."""

    def __init__(self, rate: float, burst: float | None = None):
        self.rate, self.burst = rate, burst if burst is not None else max(1.0, rate)
        self.left, self.last = self.burst, None

    def take(self, t: float) -> bool:
        if self.last is not None:
            self.left = min(self.burst, self.left + max(0.0, t - self.last) * self.rate)
        self.last = t if self.last is None else max(self.last, t)
        if self.left < 1:
            return False
        self.left -= 1
        return True


def _fold(df: DataFrame, decide, extra: list[T.StructField], by_day: bool = False) -> DataFrame:
    """by_day: whether days of a key may go to different tasks. decide: makes, for a new key, a function of (seconds, events, bytes) that gives the extra columns."""
    schema = T.StructType([*df.schema.fields, *extra])
    names = [f.name for f in extra]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, of = object(), None
        for pdf in batches:
            seconds = pdf["ts"].astype("datetime64[us]").astype("int64") / 1e6
            n = pdf["events"] if "events" in pdf else pd.Series(1, pdf.index)
            size = pdf["bytes"] if "bytes" in pdf else pd.Series(0, pdf.index)
            out = []
            for k, t, e, b in zip(pdf["key"], seconds, n, size, strict=True):
                if k != key:
                    key, of = k, decide()
                out.append(of(t, e, b))
            yield pdf.assign(**{c: [x[i] for x in out] for i, c in enumerate(names)})

    dealt = df.repartition(F.col("key"), F.to_date("ts")) if by_day else df.repartition("key")
    return dealt.sortWithinPartitions("key", "ts", *ties(df, "key", "ts")).mapInPandas(run, schema)


def token_bucket(df: DataFrame, rate: float, burst: float | None = None) -> DataFrame:
    """df (key, ts, ...) with `allowed`."""

    def decide():
        bucket = Bucket(rate, burst)
        return lambda t, e, b: (bucket.take(t),)

    return _fold(df, decide, [T.StructField("allowed", T.BooleanType())])


def quota_flags(df: DataFrame, *, rate: float | None = None, burst: float | None = None, max_bytes: int | None = None, max_events: int | None = None) -> DataFrame:
    """df (key, ts, events, bytes) with `refused`: rate, bytes, events or null, checked in that order.

    Quotas are of a UTC day, and only what was accepted counts.
    """

    def decide():
        bucket, day, used = Bucket(rate, burst) if rate is not None else None, None, [0, 0]

        def one(t, e, b):
            nonlocal day
            if day != t // 86400:
                day, used[:] = t // 86400, [0, 0]
            if bucket is not None and not bucket.take(t):
                return ("rate",)
            if max_bytes is not None and used[1] + b > max_bytes:
                return ("bytes",)
            if max_events is not None and used[0] + e > max_events:
                return ("events",)
            used[0] += e
            used[1] += b
            return (None,)

        return one

    return _fold(df, decide, [T.StructField("refused", T.StringType())], by_day=rate is None)


def retried(df: DataFrame, minutes: int = 10) -> DataFrame:
    """df (batch_id, ts) with `duplicate`: a batch id seen less than so many minutes after its first sighting; null and empty ids never are."""

    def decide():
        first = None

        def one(t, e, b):
            nonlocal first
            again = first is not None and t < first + 60 * minutes
            first = first if again else t
            return (again,)

        return one

    named = F.coalesce(F.col("batch_id") != "", F.lit(False))
    found = _fold(df.where(named).withColumn("key", F.col("batch_id")), decide, [T.StructField("duplicate", T.BooleanType())]).drop("key")
    return found.unionByName(df.where(~named).withColumn("duplicate", F.lit(False)))
