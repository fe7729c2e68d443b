"""Rules on streams by timers give what a backtest gives, over many micro-batches, windows without rows among them."""

from __future__ import annotations

import json
import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from emberlog.operators import alerts as R
from emberlog.streaming import rules as SR
from emberlog.streaming import streams as W
from tests.conftest import BASE

RULES = [
    R.Rule("count", "n", "gt", 3, filters=(("level", "=", "error"),), window_s=300, interval_s=60),
    R.Rule("dead", "n", "lt", 1, filters=(("service", "=", "gone"),), window_s=600, interval_s=120),
    R.Rule("groups", "n", "gte", 2, by=("service", "level"), window_s=240, interval_s=90),
    R.Rule("avg", "n", "gt", 40, measure=("avg", "attr.k"), by=("service",), window_s=120, interval_s=120),
    R.Rule("least", "n", "lte", 5, measure=("min", "attr.k"), window_s=180, interval_s=60),
    R.Rule("distinct", "n", "gt", 2, measure=("dc", "source"), terms=("w1",), window_s=300, interval_s=100),
]


@pytest.fixture(scope="module")
def written(spark, make_logs, tmp_path_factory):
    """Rows with gaps, some of them on the second of an evaluation, as a stream of nine files."""
    r = random.Random(12)
    rows = []
    for k in range(260):
        minute = r.choice((r.randint(0, 20), r.randint(45, 80))) + r.choice((0, 0.5, r.random()))
        rows.append((f"i{k}", minute, r.choice("abc"), f"h{r.randint(0, 4)}", r.choice(("error", "info")), f"w{r.randint(0, 2)} x", json.dumps({"k": r.randint(0, 90)} if k % 5 else {})))
    df = make_logs(rows)
    path = str(tmp_path_factory.mktemp("rules") / "in")
    W.write_in_order(df, path, files=9)
    return df, path


@pytest.mark.parametrize("rule", RULES, ids=lambda r: r.id)
def test_stream_is_the_backtest(spark, written, tmp_path, rule):
    df, path = written
    with SR.store(spark):
        start = BASE + timedelta(minutes=2)
        out = SR.evaluate_stream(W.read_logs_stream(spark, path, per_batch=1), rule, start, "2 minutes")
        out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
        got = sorted((r.at, r.value, r.firing, [(g.label, g.value) for g in r.groups]) for r in spark.read.schema(out.schema).parquet(str(tmp_path / "out")).collect())
    last = df.agg(F.max("ts")).first()[0]
    want = sorted((r.at, r.value, r.firing, [(g.label, g.value) for g in r.groups]) for r in R.backtest_rule(df, rule, start, BASE + timedelta(minutes=81)).collect())
    pane = __import__("math").gcd(rule.window_s, rule.interval_s)
    closed = [w for w in want if w[0] + timedelta(seconds=pane) <= last - timedelta(minutes=2)]
    assert len(closed) > 25 and [g[0] for g in got] == [w[0] for w in closed]
    for g, w in zip(got, closed, strict=True):
        assert g[1] == pytest.approx(w[1]) and g[2] == w[2] and [x for x, _ in g[3]] == [x for x, _ in w[3]], (g, w)
        assert [v for _, v in g[3]] == pytest.approx([v for _, v in w[3]])
    assert any(g[1] == 0 for g in got) and (rule.id != "dead" or all(g[2] for g in got))
