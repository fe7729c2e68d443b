"""Alert rules on streams by event-time timers: an evaluation at every interval, also where no row matches or none comes at all.

Rows are first counted into panes, as `backtest_rule` has them: time is cut by the greatest common divisor of window and
interval, and the cuts themselves are panes of their own, as windows are closed on both sides. A pane reaches the rule once
the watermark has passed it. The rule's state holds the panes of one window; a timer at the next evaluation fires when all
panes up to it are there, puts the window together, tells it, drops panes that no later window reads, and sets the next
timer. A rule's first timer comes from its initial state, so that it needs no row to begin with. Rows that come later than the
watermark are left out, as in any aggregation of a stream.

The stream's clock is that of all its rows, not of those that match: conditions stay above the watermark.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime
from functools import reduce
from math import gcd
from operator import and_
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from emberlog.functions import text as X
from emberlog.functions.predicates import held, name_of, real_of, text_of
from emberlog.operators.alerts import EVALUATIONS, OPS, Rule, group_label

STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


@contextmanager
def store(spark: SparkSession) -> Iterator[None]:
    """Streams that are started within keep their state in RocksDB, which timers need."""
    before = {k: spark.conf.get(k, None) for k in STORE}
    try:
        for k, v in STORE.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _matches(stream: DataFrame, rule: Rule) -> Column:
    conditions = [f if isinstance(f, Column) else held(*f, columns=stream.columns) for f in rule.filters]
    if rule.terms:
        conditions.append(X.holds(X.searchable(), rule.terms))
    return F.coalesce(reduce(and_, conditions, F.lit(True)), F.lit(False))


def panes(stream: DataFrame, rule: Rule, start: datetime, watermark: str) -> DataFrame:
    """(rule_id, node, label, n, x, v) of each closed pane: rows and sum, least or largest value of a group, and for `dc` its values."""
    func, field = rule.measure[0], rule.measure[1] if len(rule.measure) > 1 else None
    if func not in ("count", "sum", "avg", "min", "max", "dc") or func != "count" and field is None:
        raise ValueError(f"no measure of a rule: {rule.measure}")
    pane = gcd(rule.interval_s, rule.window_s)
    t = F.unix_micros("ts") - F.lit(int(start.timestamp() * 1e6))
    keys = F.create_map(*[x for f in rule.by for x in (F.lit(name_of(f)), F.coalesce(text_of(f), F.lit("")))]) if rule.by else F.create_map().cast("map<string,string>")
    width = f"{pane} seconds"
    marked = stream.withWatermark("ts", watermark).select(
        "ts",
        F.when(F.pmod(t, F.lit(pane * 1_000_000)) == 0, 0).otherwise(1).alias("inner"),
        F.when(_matches(stream, rule), group_label(keys)).alias("label"),
        (F.lit(1.0) if func == "count" else F.lit(None).cast("double") if func == "dc" else real_of(field)).cast("double").alias("x"),
        (text_of(field) if func == "dc" else F.lit(None).cast("string")).alias("v"),
    )
    merged = {"min": F.min, "max": F.max}.get(func, F.sum)("x")
    window = F.window("ts", width, startTime=f"{int(start.timestamp()) % pane} seconds")
    held_ = marked.groupBy(window.alias("w"), "inner", "label").agg(F.count("x").alias("n"), merged.alias("x"), F.collect_set("v").alias("v"))
    node = 2 * F.floor((F.unix_micros("w.start") - F.lit(int(start.timestamp() * 1e6))) / (pane * 1_000_000)).cast("long") + F.col("inner")
    return held_.select(F.lit(rule.id).alias("rule_id"), node.alias("node"), "label", "n", "x", "v")


class _Timers(StatefulProcessor):
    """The state of a rule: the next evaluation, and the panes {node: {label: [n, x, values]}} that it and later ones read."""

    def __init__(self, rule: Rule, start: datetime):
        self.rule, self.start = rule, int(start.timestamp() * 1000)
        self.step, self.width, self.pane = rule.interval_s * 1000, rule.window_s * 1000, gcd(rule.interval_s, rule.window_s) * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("rule", "next long, panes string")

    def handleInitialState(self, key: Any, initialState: pd.DataFrame, timerValues: Any) -> None:  # noqa: N802
        self.state.update((self.start, "{}"))
        self.handle.registerTimer(self.start + self.pane)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802
        at, held = self.state.get()
        found = json.loads(held)
        for pdf in rows:
            for node, label, n, x, v in zip(pdf["node"], pdf["label"], pdf["n"], pdf["x"], pdf["v"], strict=True):
                if label is not None and node >= self.lowest(at):
                    found.setdefault(str(node), {})[label] = [int(n), None if x != x or x is None else float(x), sorted(v)]
        self.state.update((at, json.dumps(found)))
        return iter(())

    def lowest(self, at: int) -> int:
        return 2 * ((at - self.width - self.start) // self.pane)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802
        at, held = self.state.get()
        found, out = {int(k): v for k, v in json.loads(held).items()}, []
        while at + self.pane <= timerValues.getCurrentWatermarkInMs():  # the pane of the end itself has passed
            out.append(self.evaluation(at, found))
            at += self.step
            found = {k: v for k, v in found.items() if k >= self.lowest(at)}
        self.state.update((at, json.dumps(found)))
        self.handle.registerTimer(at + self.pane)
        if out:
            yield pd.DataFrame(out, columns=["rule_id", "at", "value", "firing", "groups"])

    def evaluation(self, at: int, found: dict[int, dict[str, list]]) -> tuple:
        low, high = self.lowest(at), 2 * ((at - self.start) // self.pane)
        groups: dict[str, list[list]] = {}
        for node in (k for k in found if low <= k <= high):
            for label, cell in found[node].items():
                groups.setdefault(label, []).append(cell)
        values = {label: v for label, cells in groups.items() if (v := self.value(cells)) is not None}
        holds = lambda v: bool(OPS[self.rule.op](v, float(self.rule.value)))
        extreme = min if self.rule.op in ("lt", "lte") else max
        value = extreme(values.values()) if values else 0.0
        hits = sorted((-v, label) for label, v in values.items() if holds(v))
        listed = [{"label": label, "value": -v} for v, label in hits] if self.rule.by else []
        return self.rule.id, pd.Timestamp(at, unit="ms"), value, bool(hits) if values else holds(0.0), listed

    def value(self, cells: list[list]) -> float | None:
        func = self.rule.measure[0]
        n, xs = sum(c[0] for c in cells), [c[1] for c in cells if c[1] is not None]
        if func == "dc":
            return float(len({v for c in cells for v in c[2]})) or None
        if func == "count":
            return float(n) or None
        return None if not xs else min(xs) if func == "min" else max(xs) if func == "max" else sum(xs) / (n if func == "avg" else 1)

    def close(self) -> None:
        pass


def evaluate_stream(stream: DataFrame, rule: Rule, start: datetime, watermark: str = "10 minutes") -> DataFrame:
    """The evaluations (see EVALUATIONS) of a rule at start and every interval after it, each once the watermark has passed it by a pane.

    start is a whole second. Start the stream within `store`. One task holds a rule's panes of a window, not its rows.
    """
    rule.validate()
    spark = stream.sparkSession
    first = spark.createDataFrame([(rule.id,)], "rule_id string").groupBy("rule_id")
    return panes(stream, rule, start, watermark).groupBy("rule_id").transformWithStateInPandas(_Timers(rule, start), EVALUATIONS, "append", "eventTime", initialState=first)
