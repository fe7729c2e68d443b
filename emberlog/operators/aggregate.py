"""Statistics, time charts, top values, histograms, facets and the figures of an overview.

A measure is ("count",), ("count", field), or one of sum, avg, min, max, dc, adc (dc by sketches) with a field; its column is named
`count` or func(field). Sums and the like read fields as numbers, as a text's leading number is one.
"""

from __future__ import annotations

import operator
from collections.abc import Sequence
from datetime import timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.functions.predicates import name_of, real_of, text_of
from emberlog.functions.scalars import duration

#: Relative error of the approximate distinct count (adc).
ERROR = 0.02
NUMERIC = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}
#: The bucket of each range of the histogram.
WIDTHS = {"15m": "30s", "1h": "1m", "6h": "5m", "24h": "30m", "168h": "6h"}


def _titled(func: str, field: str | None = None) -> str:
    return func if field is None else f"{func}({field.removeprefix('attr.')})"


def measure(func: str, field: str | None = None) -> Column:
    name = _titled(func, field)
    if func == "count":
        return F.count(F.lit(1)).alias(name)
    if field is None:
        raise ValueError(f"{func} needs a field")
    if func == "dc":
        return F.count_distinct(text_of(field)).alias(name)
    if func == "adc":
        return F.approx_count_distinct(text_of(field), ERROR).alias(name)
    if func not in NUMERIC:
        raise ValueError(f"unknown function {func!r}")
    return NUMERIC[func](real_of(field)).alias(name)


def _keys(fields: Sequence[str]) -> list[Column]:
    return [text_of(f).alias(name_of(f)) for f in fields]


def _shown(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Missing keys print as empty, but stay groups of their own."""
    return df.withColumns({name_of(f): F.coalesce(F.col(f"`{name_of(f)}`"), F.lit("")) for f in fields}) if fields else df


def _ordered(df: DataFrame, first: Column, names: Sequence[str]) -> DataFrame:
    return df.orderBy(first, *[F.col(f"`{n}`").asc_nulls_first() for n in names])


def _grouped(df: DataFrame, measures: Sequence[tuple], by: Sequence[str]) -> DataFrame:
    """A row per group. Sketches are made apart from exact distinct counts, whose aggregation would hold one for each value."""
    kinds = {m[0] for m in measures}
    if not {"dc", "adc"} <= kinds:
        return df.groupBy(*_keys(by)).agg(*[measure(*m) for m in measures])
    named = [k.alias(f"_by{i}") for i, k in enumerate(_keys(by))]
    parts = [df.groupBy(*named).agg(*[measure(*m).alias(f"{side}{i}") for i, m in enumerate(measures) if (m[0] == "adc") == (side == "b")]) for side in "ab"]
    one, other = parts[0], parts[1].withColumnsRenamed({f"_by{i}": f"_of{i}" for i in range(len(by))})
    met = one.join(other, reduce(operator.and_, [F.col(f"_by{i}").eqNullSafe(F.col(f"_of{i}")) for i in range(len(by))])) if by else one.crossJoin(other)
    values = [F.col(f"{'b' if m[0] == 'adc' else 'a'}{i}").alias(_titled(*m)) for i, m in enumerate(measures)]
    return met.select(*[F.col(f"_by{i}").alias(name_of(f)) for i, f in enumerate(by)], *values)


def stats(df: DataFrame, measures: Sequence[tuple], by: Sequence[str] = ()) -> DataFrame:
    """A row per group, the first measure falling; without keys one row, even of nothing."""
    out = _grouped(df, measures, by)
    if not by:
        return out
    first = F.col(f"`{out.columns[len(by)]}`").desc()
    return _ordered(_shown(out, by), first, [name_of(f) for f in by])


def bucket(span: str | timedelta, ts: Column | None = None) -> Column:
    """Start of the bucket, aligned to the epoch."""
    width = duration(span) if isinstance(span, str) else span
    micros = int(width.total_seconds() * 1_000_000)
    t = F.col("ts") if ts is None else ts
    return F.timestamp_micros((F.floor(F.unix_micros(t) / F.lit(micros)) * F.lit(micros)).cast("long"))


def timechart(df: DataFrame, measures: Sequence[tuple], span: str = "1m", by: str | None = None) -> DataFrame:
    fields = [by] if by else []
    if by is not None and not isinstance(by, str):
        raise ValueError("a time chart takes one field")
    out = df.groupBy(bucket(span).alias("bucket"), *_keys(fields)).agg(*[measure(*m) for m in measures])
    return _ordered(_shown(out, fields), F.col("bucket").asc(), [name_of(f) for f in fields])


def _ranked(df: DataFrame, fields: Sequence[str], n: int, falling: bool) -> DataFrame:
    if not 1 <= n <= 1000:
        raise ValueError("n is 1 to 1000")
    out = _shown(df.groupBy(*_keys(fields)).agg(measure("count")), fields)
    return _ordered(out, F.col("count").desc() if falling else F.col("count").asc(), [name_of(f) for f in fields]).limit(n)


def top(df: DataFrame, fields: Sequence[str], n: int = 10) -> DataFrame:
    return _ranked(df, fields, n, True)


def rare(df: DataFrame, fields: Sequence[str], n: int = 10) -> DataFrame:
    return _ranked(df, fields, n, False)


def capped(ordered: DataFrame, limit: int = 1000) -> DataFrame:
    """The first rows of an ordered result, with `truncated`: whether there were more."""
    more = ordered.limit(limit + 1).withColumn("_k", F.monotonically_increasing_id())
    n = Window.orderBy("_k")
    return more.withColumn("_k", F.row_number().over(n)).withColumn("truncated", F.count(F.lit(1)).over(Window.partitionBy()) > limit).where(F.col("_k") <= limit).drop("_k")


def histogram(df: DataFrame, interval: str = "1m") -> DataFrame:
    return timechart(df, [("count",)], interval)


def histogram_and_total(df: DataFrame, interval: str = "1m") -> DataFrame:
    """A histogram with the exact number of all rows beside each bucket."""
    return histogram(df, interval).withColumn("total", F.sum("count").over(Window.partitionBy()))  # of a histogram: few rows


def facets(df: DataFrame, fields: Sequence[str] = ("level", "service"), n: int = 20) -> DataFrame:
    """(field, value, count): the n most frequent values of each field, in one pass."""
    names = [name_of(f) for f in fields]
    source = df.select(*_keys(fields))
    counted = source.groupingSets([[F.col(f"`{x}`")] for x in names], *[F.col(f"`{x}`") for x in names]).agg(F.grouping_id().alias("g"), F.count(F.lit(1)).alias("count"))
    full = (1 << len(names)) - 1
    which, value = F, F
    for k, x in enumerate(names):
        here = F.col("g") == (full ^ (1 << (len(names) - 1 - k)))
        which, value = which.when(here, x), value.when(here, F.col(f"`{x}`"))
    flat = counted.select(which.alias("field"), F.coalesce(value, F.lit("")).alias("value"), "count")
    rank = Window.partitionBy("field").orderBy(F.col("count").desc(), "value")
    return flat.withColumn("k", F.row_number().over(rank)).where(F.col("k") <= n).drop("k")


def fill_gaps(hist: DataFrame, step: timedelta | None = None, cap: int = 1000) -> DataFrame:
    """(bucket, count, truncated) without gaps, by the smallest distance of two buckets; at most `cap` points, and
    truncated where there would be more."""
    micros = F.unix_micros("bucket")
    gap = micros - F.lag(micros).over(Window.orderBy("bucket"))  # of a histogram: few rows
    width = F.coalesce(F.min("d"), F.lit(1)) if step is None else F.lit(int(step.total_seconds() * 1_000_000))
    ends = hist.select(micros.alias("m"), (gap if step is None else F.lit(1)).alias("d")).agg(F.min("m").alias("a"), F.max("m").alias("b"), width.cast("long").alias("w")).where("a is not null")
    last = F.col("a") + F.col("w") * (cap - 1)
    spine = ends.select(F.explode(F.sequence("a", F.least("b", last), "w")).alias("m"), (F.col("b") > last).alias("truncated"))
    spine = spine.select(F.timestamp_micros("m").alias("bucket"), "truncated")
    return spine.join(hist, "bucket", "left").select("bucket", F.coalesce("count", F.lit(0)).alias("count"), "truncated").orderBy("bucket")


def bucket_for(span: str) -> str:
    """Width of the buckets of a range."""
    return WIDTHS.get(span, "1h")


def overview(df: DataFrame, firing: int = 0) -> DataFrame:
    bad = F.col("level").isin("error", "fatal")
    return df.agg(F.count(F.lit(1)).alias("total"), F.count_if(bad).alias("errors"), F.count_if(F.col("level") == "warn").alias("warnings"), F.count_distinct("service").alias("services"), F.lit(firing).cast("long").alias("firing"))


def busiest(df: DataFrame, n: int = 8) -> DataFrame:
    """The services with most rows, with their share of the largest in per cent."""
    most = F.max("count").over(Window.partitionBy())
    return top(df, ["service"], n).withColumn("share", F.round(100 * F.col("count") / most).cast("long"))


def recent_errors(df: DataFrame, n: int = 8) -> DataFrame:
    return df.where(F.col("level").isin("error", "fatal")).orderBy(F.desc("ts"), F.desc("id")).limit(n)


def capped_count(df: DataFrame, cap: int | None = 50_000) -> DataFrame:
    """(count, capped): the exact count, or with a cap at most that."""
    if cap is None:
        return df.agg(F.count(F.lit(1)).alias("count")).withColumn("capped", F.lit(False))
    n = df.limit(cap + 1).agg(F.count(F.lit(1)).alias("n"))
    return n.select(F.least("n", F.lit(cap)).cast("long").alias("count"), (F.col("n") > cap).alias("capped"))


def le_histogram(df: DataFrame, value: Column, bounds: Sequence[float], labels: Sequence[str] = ()) -> DataFrame:
    """(labels, le, count, sum, total): rows at most each bound, and +Inf, with the sum and count of all."""
    counts = [F.count_if(value <= b) for b in bounds] + [F.count(value)]
    names = [F.lit(format(b, "g")) for b in bounds] + [F.lit("+Inf")]
    rows = df.groupBy(*labels).agg(F.array(*[F.struct(n.alias("le"), c.alias("count")) for n, c in zip(names, counts, strict=True)]).alias("b"), F.sum(value).alias("sum"), F.count(value).alias("total"))
    return rows.select(*labels, F.explode("b").alias("b"), "sum", "total").select(*labels, "b.le", "b.count", "sum", "total")


def observe_counts(accepted: DataFrame, rejected: DataFrame, dropped: DataFrame | None = None, duplicate: DataFrame | None = None) -> DataFrame:
    """(outcome, count): a row per outcome of a batch."""
    sides = {"accepted": accepted, "rejected": rejected, "dropped": dropped, "duplicate": duplicate}
    made = [d.agg(F.count(F.lit(1)).alias("count")).select(F.lit(k).alias("outcome"), "count") for k, d in sides.items() if d is not None]
    out = made[0]
    for d in made[1:]:
        out = out.unionByName(d)
    return out


def event_rate(df: DataFrame) -> DataFrame:
    """(second, count)."""
    return df.groupBy(bucket("1s").alias("second")).agg(F.count(F.lit(1)).alias("count"))
