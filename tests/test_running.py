"""Running totals of hot keys, distinct counts by sketches, and streams that begin where history ends."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from pyspark.sql import Window
from pyspark.sql import functions as F

from emberlog.operators import aggregate as A
from emberlog.operators import alerts as R
from emberlog.operators import paging as L
from emberlog.streaming import streams as W
from tests.conftest import BASE


def test_daily_usage_of_a_hot_key(spark):
    """Equal to a window, with ties, repeats and nulls; the hot key's rows are summed by several tasks."""
    r = random.Random(4)
    rows = [("hot" if r.random() < 0.9 else r.choice(["a", "b", None]), BASE + timedelta(seconds=r.randrange(200_000)), r.choice([1, 2, None]), r.randrange(1000), k % 700) for k in range(4000)]
    df = spark.createDataFrame(rows, "key string, ts timestamp, events long, bytes long, n int")
    w = Window.partitionBy("key", F.to_date("ts")).orderBy("ts", *L.ties(df, "key", "ts")).rowsBetween(Window.unboundedPreceding, 0)
    want = df.withColumns({"events_so_far": F.sum("events").over(w), "bytes_so_far": F.sum("bytes").over(w)})
    got = L.daily_usage(df.repartition(8))
    assert got.columns == want.columns and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "_part" in plan  # the window's groups are parts of a key
    assert L.daily_usage(df.limit(0)).count() == 0


def test_rule_sketches_of_many_values(spark, tmp_path):
    """Thousands of sources in an hour: what the query gives is the exact count."""
    from emberlog.plans.registry import QUERIES

    rows = [(k, datetime(2024, 1, 1) + timedelta(milliseconds=1000 * k), k % 5000, "view", 1.0, '{"k": 1}') for k in range(7000)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.at: (r.value, r.firing) for r in QUERIES["g4_rule_sketches"](spark, str(tmp_path)).collect()}
    for at, (value, firing) in got.items():
        n = len({u for _, t, u, *_ in rows if at - timedelta(hours=1) <= t <= at})
        assert value == n and firing == (n > 8)


def test_sketches_apart_from_exact_counts(make_logs):
    """No sketch for each value: in the plan the approximate count isn't grouped by what is counted exactly; values are as before."""
    df = make_logs([(f"{k}", k, None if k % 3 else "s", f"h{k % 40}", "info", "m", '{"k": 2}') for k in range(300)])
    got = A.stats(df, [("dc", "source"), ("count",), ("adc", "source"), ("sum", "attr.k")], ["service"])
    assert got.columns == ["service", "dc(source)", "count", "adc(source)", "sum(k)"]
    assert [(r[0], r[1], r[2], r[4]) for r in got.collect()] == [("", 40, 200, 400.0), ("s", 40, 100, 200.0)]
    assert all(abs(r[3] - 40) <= 4 for r in got.collect())
    assert A.stats(df, [("adc", "source"), ("dc", "service")]).collect()[0]["dc(service)"] == 1
    plan = got._jdf.queryExecution().optimizedPlan().toString() + got._jdf.queryExecution().executedPlan().toString()
    assert not any("approx_count_distinct" in line and "distinct " in line.split("approx_count_distinct")[0] for line in plan.split("\n") if "Aggregate" in line)
    assert not any("approx_count_distinct" in line and "count(" in line for line in plan.split("\n") if "Aggregate" in line)


def test_sketches_of_panes(make_logs):
    """Few values are counted as exactly as by sets, many nearly; what panes hold doesn't grow with the values."""
    df = make_logs([(f"{k}", k / 10, "s", f"h{k % 900}" if k > 100 else f"h{k % 7}", "info", "m", "{}") for k in range(3000)])
    rule = R.Rule("r", "r", "gt", 5, measure=("adc", "source"), by=("service",), window_s=1800, interval_s=60)
    exact = R.Rule("r", "r", "gt", 5, measure=("dc", "source"), by=("service",), window_s=1800, interval_s=60)
    near = {x.at: x.value for x in R.backtest_rule(df, rule, BASE, BASE + timedelta(hours=5)).collect()}
    for x in R.backtest_rule(df, exact, BASE, BASE + timedelta(hours=5)).collect():
        assert abs(near[x.at] - x.value) <= (0 if x.value < 50 else 0.05 * x.value)


def test_follow_from_the_seam(spark, make_logs, tmp_path):
    """History's last rows once, then only what comes after it, over a restart too."""
    rows = [(f"{k:03}", k, "s", "h", "error" if k % 2 else "info", "m", "{}") for k in range(40)]
    path, got = str(tmp_path / "in"), []
    make_logs(rows[:20]).write.parquet(path)
    sink = lambda b, k: got.extend(r.id for r in b.collect())
    start = lambda: W.follow(spark.read.parquet(path), W.read_logs_stream(spark, path), sink, str(tmp_path / "ck"), [("level", "=", "error")], n=3).awaitTermination()
    start()
    assert got == ["015", "017", "019"]
    make_logs(rows[20:30]).write.mode("append").parquet(path)
    start()
    make_logs(rows[30:]).write.mode("append").parquet(path)
    start()
    assert got[:3] == ["015", "017", "019"] and sorted(got[3:]) == [f"{k:03}" for k in range(21, 40, 2)]


def test_empty_batch_ids_are_no_retries(spark, tmp_path):
    rows = [("", 1), ("", 1), (None, 1), (None, 1), ("a", 1), ("a", 1)]
    df = spark.createDataFrame([(b, n, BASE) for b, n in rows], "batch_id string, line_no long, received_at timestamp")
    df.write.parquet(str(tmp_path / "in"))
    W.run_to_table(W.dedupe_batches(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))), "empties")
    assert sorted(str(r.batch_id) for r in spark.table("empties").collect()) == ["", "", "None", "None", "a"]
