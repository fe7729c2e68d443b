"""Alert rules as data: conditions, evaluations over time, states, and notifications to send."""

from __future__ import annotations

import operator
from collections.abc import Sequence
from dataclasses import dataclass, replace
from datetime import datetime, timedelta
from functools import reduce
from math import gcd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.functions.predicates import name_of, real_of, search, text_of
from emberlog.operators.paging import first_of, ties

OPS = {"gt": operator.gt, "gte": operator.ge, "lt": operator.lt, "lte": operator.le, "eq": operator.eq, "ne": operator.ne}
SIGNS = {"gt": ">", "gte": ">=", "lt": "<", "lte": "<=", "eq": "==", "ne": "!="}
SEVERITIES = ("info", "warning", "critical")
EVALUATIONS = "rule_id string, at timestamp, value double, firing boolean, groups array<struct<label:string,value:double>>"


@dataclass(frozen=True)
class Rule:
    """One condition on a measure of what matches, over `window_s` seconds up to each evaluation."""

    id: str
    name: str
    op: str
    value: float
    filters: tuple = ()
    terms: tuple[str, ...] = ()
    measure: tuple = ("count",)
    by: tuple[str, ...] = ()
    window_s: int = 300
    interval_s: int = 60
    severity: str = "warning"
    channels: tuple[str, ...] = ()
    query: str = ""
    enabled: bool = True

    def validate(self) -> None:
        if self.op not in OPS:
            raise ValueError(f"{self.id}: unknown condition {self.op!r}")
        if self.interval_s < 10:
            raise ValueError(f"{self.id}: an interval is 10 s at least")
        if not 10 <= self.window_s <= 30 * 86400:
            raise ValueError(f"{self.id}: a window is 10 s to 30 days")
        if self.window_s < self.interval_s:
            raise ValueError(f"{self.id}: the window is shorter than the interval")
        if self.severity not in SEVERITIES:
            raise ValueError(f"{self.id}: unknown severity {self.severity!r}")


def condition(value: Column, op: str, bound: float) -> Column:
    return OPS[op](value, F.lit(float(bound)))


def group_label(labels: Column) -> Column:
    """k=v of a map, sorted, with blanks between."""
    pairs = F.transform(F.map_entries(labels), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit(""))))
    return F.array_join(F.array_sort(pairs), " ")


FAN = 16  # panes that make one of the next level


def _node(level: int):
    return lambda n: F.struct(F.lit(level).alias("level"), n.alias("node"))


def _nodes(lo: Column, hi: Column, levels: int) -> Column:
    """Panes (level, node) of FAN**level panes each that part those from lo to hi, both included, into few."""
    out, a, b = [], lo, hi + 1
    for level in range(levels):
        up, down = F.ceil(a / F.lit(FAN)).cast("long") * FAN, F.floor(b / F.lit(FAN)).cast("long") * FAN
        whole = (up >= down) if level < levels - 1 else F.lit(True)
        span = lambda x, y: F.when(x < y, F.sequence(x, y - 1)).otherwise(F.array().cast("array<bigint>"))
        own = F.when(whole, span(a, b)).otherwise(F.concat(span(a, up), span(down, b)))
        out.append(F.transform(own, _node(level)))
        a, b = F.when(whole, F.lit(0)).otherwise(up / FAN).cast("long"), F.when(whole, F.lit(0)).otherwise(down / FAN).cast("long")
    return F.flatten(F.array(*out))


def _partial(m: tuple) -> tuple[list[Column], list[Column], Column]:
    """(what a pane holds of a measure, how panes are merged, the value of what is merged); columns n, x."""
    func, field = m[0], m[1] if len(m) > 1 else None
    if func != "count" and field is None:
        raise ValueError(f"{func} needs a field")
    if func == "count":
        return [F.count(F.lit(1)).alias("n")], [F.sum("n").alias("n")], F.col("n")
    if func == "adc":  # sketches of a pane's values, of a few kB however many there are
        return [F.hll_sketch_agg(text_of(field), 12).alias("x")], [F.hll_union_agg("x").alias("x")], F.hll_sketch_estimate("x")
    real = real_of(field)
    if func in ("sum", "avg"):
        value = F.col("x") if func == "sum" else F.try_divide("x", "n")
        return [F.count(real).alias("n"), F.sum(real).alias("x")], [F.sum("n").alias("n"), F.sum("x").alias("x")], value
    if func not in ("min", "max"):
        raise ValueError(f"unknown function {func!r}")
    of = F.min if func == "min" else F.max
    return [of(real).alias("x")], [of("x").alias("x")], F.col("x")


def backtest_rule(df: DataFrame, rule: Rule, start: datetime, end: datetime) -> DataFrame:
    """An evaluation (see EVALUATIONS) at start and every interval after it, to end; windows are closed on both sides.

    Events are aggregated once, by group and pane: the greatest common divisor of window and interval cuts time into
    panes without their ends, and the ends, which two windows may share, are panes of their own. FAN panes make one of
    the next level, and so on, so that a window of any length is put together from a few; no event is copied.
    Evaluations without any event come from the list of all.
    """
    rule.validate()
    first, step, width = int(start.timestamp() * 1e6), rule.interval_s * 1_000_000, rule.window_s * 1_000_000
    n = (int(end.timestamp() * 1e6) - first) // step + 1
    pane = gcd(step, width)
    back = 2 * (width // pane)  # panes before the first evaluation, so that none is numbered below zero
    spine = df.sparkSession.range(n).select(F.col("id").alias("k"))
    matching = search(df, rule.filters, rule.terms, start - timedelta(seconds=rule.window_s), end)
    t = F.unix_micros("ts") - F.lit(first - width)
    at = (2 * F.floor(t / F.lit(pane)) + F.when(F.pmod(t, F.lit(pane)) == 0, 0).otherwise(1)).cast("long").alias("node")
    names = [name_of(f) for f in rule.by]
    keys = [text_of(f).alias(f"_by{i}") for i, f in enumerate(rule.by)]  # a field may have the name of any column below
    named = [F.col(f"_by{i}") for i in range(len(keys))]
    distinct = rule.measure[0] == "dc"
    if distinct:
        held = matching.select(at, *keys, text_of(rule.measure[1]).alias("v")).where("v is not null").distinct()
        merge, value, by = [], F.count_distinct("v"), [*named, F.col("v")]
    else:
        parts, merge, value = _partial(rule.measure)
        held, by = matching.groupBy(at, *keys).agg(*parts), named
    cells, levels = back + 2 * (n - 1) * (step // pane) + 1, 1
    while FAN**levels < cells:
        levels += 1
    wide = held.withColumn("level", F.explode(F.array(*map(F.lit, range(levels)))))
    power = F.element_at(F.array(*[F.lit(FAN**k) for k in range(levels)]), F.col("level") + 1)
    wide = wide.withColumn("node", F.floor(F.col("node") / power).cast("long"))
    wide = wide.distinct() if distinct else wide.groupBy("level", "node", *by).agg(*merge)
    to = back + 2 * (step // pane) * F.col("k")
    wanted = spine.select("k", F.explode(_nodes(to - back, to, levels)).alias("p")).select("k", "p.level", "p.node")
    met = wanted.join(wide, ["level", "node"]).groupBy("k", *named)
    grouped = met.agg(value.alias("v_")) if distinct else met.agg(*merge).withColumn("v_", value)
    labels = F.create_map(*[x for f, c in zip(names, named, strict=True) for x in (F.lit(f), F.coalesce(c, F.lit("")))]) if names else F.create_map().cast("map<string,string>")
    rows = grouped.select("k", F.col("v_").cast("double").alias("v"), group_label(labels).alias("label")).where("v is not null")
    extreme = F.min("v") if rule.op in ("lt", "lte") else F.max("v")
    breach = condition(F.col("v"), rule.op, rule.value)
    listed = F.array_sort(F.collect_list(F.when(breach, F.struct((-F.col("v")).alias("o"), "label", "v"))))
    summed = rows.groupBy("k").agg(extreme.alias("value"), F.max(breach).alias("hit"), listed.alias("g"))
    found = spine.join(summed, "k", "left")
    zero = F.coalesce("value", F.lit(0.0))
    groups = F.transform(F.coalesce("g", F.array().cast("array<struct<o:double,label:string,v:double>>")), lambda g: F.struct(g["label"].alias("label"), g["v"].alias("value")))
    return found.select(
        F.lit(rule.id).alias("rule_id"),
        F.timestamp_micros(F.lit(first) + F.col("k") * step).alias("at"),
        zero.alias("value"),
        F.coalesce("hit", condition(F.lit(0.0), rule.op, rule.value)).alias("firing"),
        (groups if rule.by else F.array().cast("array<struct<label:string,value:double>>")).alias("groups"),
    )


def backtest_sketches(df: DataFrame, rule: Rule, start: datetime, end: datetime) -> DataFrame:
    """The evaluations of a rule on `adc`, and beside them `estimate`, what its sketches say: value and firing are of the exact count.

    Sketches count a few hundred values exactly and are off by some hundredths beyond; the exact count takes each value of a pane once.
    """
    if rule.measure[0] != "adc":
        raise ValueError(f"{rule.id}: {rule.measure[0]} isn't counted by sketches")
    exact = backtest_rule(df, replace(rule, measure=("dc", *rule.measure[1:])), start, end)
    sketched = backtest_rule(df, rule, start, end).select("at", F.col("value").alias("estimate"))
    return exact.join(sketched, "at").select(*exact.columns, "estimate")


def valid(rules: Sequence[Rule]) -> list[Rule]:
    """The rules that hold what `Rule.validate` asks."""
    out = []
    for r in rules:
        try:
            r.validate()
        except ValueError:
            continue
        out.append(r)
    return out


def evaluate(df: DataFrame, rule: Rule, at: datetime) -> DataFrame:
    """The evaluation of one rule at one time."""
    return backtest_rule(df, rule, at, at)


def backtest(df: DataFrame, rules: Sequence[Rule], start: datetime, end: datetime) -> DataFrame:
    made = [backtest_rule(df, r, start, end) for r in rules if r.enabled]
    return reduce(DataFrame.unionByName, made) if made else df.sparkSession.createDataFrame([], EVALUATIONS)


def transitions(evaluations: DataFrame) -> DataFrame:
    """evaluations with state (ok, firing, or unknown where `error` isn't null), previous, and notify.

    Told are a change to firing and one from firing to ok; unknown is silent.
    """
    failed = F.col("error").isNotNull() if "error" in evaluations.columns else F.lit(False)
    state = F.when(failed, "unknown").when(F.col("firing"), "firing").otherwise("ok")
    rows = evaluations.withColumn("state", state)
    rows = rows.withColumn("previous", F.lag("state").over(Window.partitionBy("rule_id").orderBy("at", *ties(evaluations, "rule_id", "at"))))
    turned = (F.col("state") == "firing") & ~F.col("previous").eqNullSafe("firing")
    cleared = (F.col("state") == "ok") & F.col("previous").eqNullSafe("firing")
    return rows.withColumn("notify", turned | cleared)


def rules_frame(spark, rules: Sequence[Rule]) -> DataFrame:
    rows = [(r.id, r.name, SIGNS[r.op], float(r.value), r.window_s, r.severity, r.query, list(r.channels)) for r in rules]
    return spark.createDataFrame(rows, "rule_id string, rule string, sign string, bound double, window_s int, severity string, query string, channels array<string>")


def notifications(turned: DataFrame, rules: Sequence[Rule], channels: DataFrame, source: str = "emberlog", test: bool = False) -> DataFrame:
    """A row for each transition and channel (id, type, url): text, payload and missing, true where a rule names no known channel.

    test: probes of all rows instead, which are neither firing nor resolved, and differ from each other.
    """
    number = lambda c: F.regexp_replace(c.cast("string"), r"\.0$", "")
    told = (turned if test else turned.where("notify")).join(rules_frame(turned.sparkSession, rules), "rule_id")
    head = F.lit("🔔 TEST: ") if test else F.when(F.col("state") == "firing", "🔴 FIRING: ").otherwise("✅ RESOLVED: ")
    limit = F.concat_ws(" ", "sign", number(F.col("bound")))
    over = F.concat(F.col("window_s").cast("string"), F.lit("s"))
    lines = F.transform("groups", lambda g: F.concat(F.lit("  • "), g["label"], F.lit(": "), number(g["value"])))
    listed = F.when(F.size("groups") > 0, F.concat(F.lit("\n"), first_of(lines))).otherwise("")
    text = F.concat(head, F.col("rule"), F.lit(" — "), number(F.col("value")), F.lit(" "), limit, F.lit(" over "), over, listed, F.lit("\nquery: "), F.col("query"))
    told = told.withColumns({"text": text, "limit": limit, "over": over, "channel": F.explode_outer("channels")})
    known = channels.select(F.col("id").alias("channel"), F.col("type").alias("channel_type"), "url")
    rows = told.join(known, "channel", "left")
    status = F.lit(None).cast("string") if test else F.when(F.col("state") == "firing", "firing").otherwise("resolved")
    event_id = F.concat(F.lit("test-"), "rule_id", F.lit("-"), F.unix_micros("at").cast("string")) if test else F.col("rule_id")
    webhook = F.to_json(F.struct("rule", "rule_id", "state", "severity", "value", F.col("limit").alias("condition"), "query", F.col("over").alias("window"), "at", "groups"))
    event = F.to_json(F.struct(event_id.alias("event_id"), F.lit("alert").alias("type"), F.lit(source).alias("source"), status.alias("status"), "severity", F.col("rule").alias("title"), F.concat_ws(" ", number(F.col("value")), "limit", F.lit("over"), "over").alias("summary"), F.col("text").alias("description"), F.struct("rule_id", "rule").alias("labels"), F.col("at").alias("timestamp")))
    payload = F.when(F.col("channel_type") == "slack", F.to_json(F.struct("text"))).when(F.col("channel_type") == "router", event).otherwise(webhook)
    return rows.select("rule_id", "at", "state", "channel", "channel_type", "url", "text", payload.alias("payload"), F.sha2(F.concat_ws("\x1f", event_id, "rule"), 256).alias("dedup_key"), F.col("channel_type").isNull().alias("missing"))
