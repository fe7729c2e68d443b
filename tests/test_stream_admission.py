"""Limits, quotas and retries on streams: over several micro-batches with rows out of order they decide as the batch queries do."""

from __future__ import annotations

import random
from datetime import timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from emberlog.operators import admission as AD
from emberlog.streaming import admission as SA
from emberlog.streaming import rules as SR
from tests.conftest import BASE

SCHEMA = "n long, key string, ts timestamp, events long, bytes long"


@pytest.fixture(scope="module")
def requests(spark, tmp_path_factory):
    """Rows of four days in five files, one after another, each shuffled and with some of the next one's time, and a last one that ends all."""
    r = random.Random(6)
    rows = [(k, r.choice("aab"), BASE + timedelta(seconds=1200 * k + r.choice((0, 0, 300, r.randrange(600)))), r.randint(1, 2), r.randrange(400)) for k in range(240)]
    path = tmp_path_factory.mktemp("requests") / "in"
    for k in range(5):
        part = rows[48 * k : 48 * (k + 1)]
        r.shuffle(part)
        if k == 4:
            part.append((999, "end", BASE + timedelta(days=40), 1, 1))
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(path))
        __import__("time").sleep(1.1)  # batches take files by the time of their change
    return spark.createDataFrame(rows, SCHEMA), str(path)


def run(spark, stream, folder):
    with SR.store(spark):
        stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/ck").trigger(availableNow=True).start(f"{folder}/out").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


@pytest.mark.parametrize("kind", ["bucket", "quota", "both", "retries"])
def test_stream_is_the_batch(spark, requests, tmp_path, kind):
    df, path = requests
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    limits = {"quota": {"max_bytes": 3000, "max_events": 20}, "both": {"rate": 1 / 2500, "burst": 3, "max_events": 15}}.get(kind)
    if kind == "bucket":
        got, want = SA.token_bucket_stream(stream, 1 / 2500, 3, "30 minutes"), AD.token_bucket(df, 1 / 2500, 3)
    elif limits:
        got, want = SA.quota_stream(stream, **limits, watermark="30 minutes"), AD.quota_flags(df, **limits)
    else:
        named = lambda d: d.withColumn("batch_id", F.when(F.col("n") % 5 == 0, "").when(F.col("n") % 7 != 0, F.concat("key", (F.col("n") % 3).cast("string")))).drop("key")
        got, want = SA.retried_stream(named(stream), 90, "30 minutes"), AD.retried(named(df), 90)
    rows = run(spark, got, str(tmp_path)).where("n <> 999").collect()
    names = sorted(want.columns)
    assert sorted(repr([r[c] for c in names]) for r in rows) == sorted(repr([r[c] for c in names]) for r in want.collect())
    assert len({r[got.columns[-1]] for r in rows}) >= 2


def test_days_of_a_key_are_dealt_out(spark, requests):
    """A quota without a rate splits a hot key by days."""
    df, _ = requests
    hot = df.withColumn("key", F.lit("hot"))
    quota = AD.quota_flags(hot, max_events=20)
    assert "to_date(ts)" in quota._jdf.queryExecution().optimizedPlan().toString() or "cast(ts" in quota._jdf.queryExecution().optimizedPlan().toString()
    per = {}
    for r in quota.orderBy("ts", *[F.col(c) for c in ("bytes", "events", "n")]).collect():
        used = per.setdefault(r.ts.date(), [0])
        assert (r.refused == "events") == (used[0] + r.events > 20)
        used[0] += r.events if r.refused is None else 0


def test_one_timer_a_key_that_is_never_listed():
    """The timer of a key follows from its state: rows and expiries cost one read and one write of it, and leave one timer at most."""

    class Handle:  # has no listTimers
        def __init__(self):
            self.timers, self.value, self.calls = [], None, 0

        def getValueState(self, name, schema):  # noqa: N802
            return self

        def get(self):
            self.calls += 1
            return self.value

        def update(self, value):
            self.calls += 1
            self.value = value

        def clear(self):
            self.calls += 1
            self.value = None

        def registerTimer(self, at):  # noqa: N802
            self.calls += 1
            self.timers.append(at)

        def deleteTimer(self, at):  # noqa: N802
            self.calls += 1
            self.timers.remove(at)

    class Watermark:
        def __init__(self, ms):
            self.ms = ms

        def getCurrentWatermarkInMs(self):  # noqa: N802
            return self.ms

    handle, limits = Handle(), SA.Limits(1 / 100, 2, None, 3)
    made = SA._InOrder(lambda: SA.Limits(1 / 100, 2, None, 3), "refused")
    made.init(handle)
    times, got = [0, 10, 20, 500, 900, 901, 1000, 90_000], []
    for batch in ([500, 20], [10, 0, 900], [901], [90_000, 1000]):
        pdf = pd.DataFrame({"micros": [t * 1_000_000 for t in batch], "ties": ['{"c0":0}'] * len(batch), "events": 1, "bytes": 0, "row": [str(t) for t in batch]})
        before = handle.calls
        list(made.handleInputRows(("a",), iter([pdf]), None))
        assert handle.calls - before <= 4 and len(handle.timers) == 1
        if batch == [901]:
            at = handle.timers.pop()
            assert at == 1
            got += [x for out in made.handleExpiredTimer(("a",), Watermark(600_000), None) for x in zip(out["row"], out["refused"], strict=True)]
            assert handle.timers == [900_001]
    while handle.timers:
        at = handle.timers.pop()
        got += [x for out in made.handleExpiredTimer(("a",), Watermark(max(at, 100_000_000)), None) for x in zip(out["row"], out["refused"], strict=True)]
        assert len(handle.timers) <= 1
    assert got == [(str(t), limits.take(float(t), 1, 0)) for t in times]
    assert handle.value is None and not handle.timers
