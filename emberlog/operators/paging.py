"""Order, pages, latest states and running totals."""

from __future__ import annotations

import tempfile
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.functions.scalars import cursor_of


def order_of(order: str) -> list[Column]:
    if order not in ("newest", "oldest"):
        raise ValueError("order is newest or oldest")
    return [F.col("ts").desc(), F.col("id").desc()] if order == "newest" else [F.col("ts").asc(), F.col("id").asc()]


def ordered(df: DataFrame, order: str = "newest") -> DataFrame:
    return df.orderBy(*order_of(order))


def ties(df: DataFrame, *but: str) -> list[Column]:
    """An order of rows that are equal in all else: by their plain columns, so that reruns agree."""
    plain = {"string", "bigint", "int", "double", "boolean", "timestamp", "timestamp_ntz", "date"}
    return [F.col(f"`{f.name}`") for f in sorted(df.schema, key=lambda f: f.name) if f.dataType.simpleString() in plain and f.name not in but]


def page(df: DataFrame, limit: int = 100, order: str = "newest", after: tuple[datetime, str] | None = None) -> DataFrame:
    """A page of rows, strictly after a cursor's (ts, id) in that order; limit is 1 to 5000."""
    if not 1 <= limit <= 5000:
        raise ValueError("limit is 1 to 5000")
    if after is not None:
        ts, id_ = F.lit(after[0]).cast("timestamp"), F.lit(after[1])
        t, i = F.col("ts"), F.col("id")
        df = df.where((t <= ts) & ((t < ts) | (i < id_))) if order == "newest" else df.where((t >= ts) & ((t > ts) | (i > id_)))
    return df.orderBy(*order_of(order)).limit(limit)


def next_cursor(rows: DataFrame, limit: int, order: str = "newest") -> DataFrame:
    """One row (cursor) of a page's rows: that of its last one if the page is full, else null."""
    last = F.max(F.struct("ts", "id")) if order == "oldest" else F.min(F.struct("ts", "id"))
    return rows.agg(F.count(F.lit(1)).alias("n"), last.alias("last")).select(F.when(F.col("n") == limit, cursor_of(F.col("last.ts"), F.col("last.id"))).alias("cursor"))


def latest_by_id(df: DataFrame, batch: str | None = None) -> DataFrame:
    """The row of each id that was received last; of equals that of the later batch, by number where batches are numbers."""
    number = [F.col(batch).cast("string").try_cast("bigint").desc_nulls_last(), F.col(batch).desc()] if batch else []
    order = [F.col("received_at").desc(), *number, *ties(df, "id", "received_at", *([batch] if batch else []))]
    return df.withColumn("_k", F.row_number().over(Window.partitionBy("id").orderBy(*order))).where("_k = 1").drop("_k")


def _written(df: DataFrame) -> DataFrame:
    """df, cut from its lineage in the shared folder; in local mode without one, in a temporary folder."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        found = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not found and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(found or tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint()


def daily_usage(df: DataFrame, key: str = "key", events: str = "events", size: str = "bytes") -> DataFrame:
    """df with the running events and bytes of each key and UTC day.

    Rows are dealt out by ranges of key, day and time, so that a key of any size goes to as many tasks as it fills; sums within
    a task's range are raised by what the ranges before it have of the same key and day.
    """
    by, sums = [F.col(f"`{key}`"), F.to_date("ts").alias("_day")], {"events_so_far": events, "bytes_so_far": size}
    order = [by[0], F.to_date("ts"), F.col("ts"), *ties(df, key, "ts")]
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_at": F.monotonically_increasing_id(), "_day": F.to_date("ts")})
    ranged = _written(ranged).withColumn("_part", F.shiftright("_at", 33))
    part = Window.partitionBy("_part", by[0], "_day").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    held = ranged.groupBy(by[0].alias("_key"), "_day", "_part").agg(*[F.sum(f"`{c}`").alias(f"_{name}") for name, c in sums.items()])
    before = Window.partitionBy("_key", "_day").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    raised = held.withColumns({f"_{name}": F.sum(f"_{name}").over(before) for name in sums}).where(" or ".join(f"_{name} is not null" for name in sums))
    raised = F.broadcast(raised.withColumnRenamed("_day", "_of").withColumnRenamed("_part", "_in"))  # a row at most for each range: the key and day that go on in it
    own = ranged.withColumns({name: F.sum(f"`{c}`").over(part) for name, c in sums.items()})
    met = own.join(raised, (F.col("_part") == F.col("_in")) & by[0].eqNullSafe(F.col("_key")) & F.col("_day").eqNullSafe(F.col("_of")), "left")
    return met.select(*[F.col(f"`{c}`") for c in df.columns], *[F.when(F.col(name).isNull() & F.col(f"_{name}").isNull(), F.lit(None)).otherwise(F.coalesce(name, F.lit(0)) + F.coalesce(f"_{name}", F.lit(0))).alias(name) for name in sums])


def unsent(df: DataFrame, sent: DataFrame) -> DataFrame:
    """Rows whose id wasn't sent before."""
    return df.join(sent.select("id"), "id", "left_anti")


def after_id(df: DataFrame, last: str) -> DataFrame:
    """Rows after the last id seen; ids sort by time."""
    return df.where(F.col("id") > last)


def first_rows(df: DataFrame, by: str, col: str, n: int = 5) -> DataFrame:
    """(by, items, total) of each group: its first n values of a column, in order, and how many there are."""
    k = F.row_number().over(Window.partitionBy(by).orderBy(col))
    few = df.select(by, col, k.alias("_k")).where(F.col("_k") <= n).groupBy(by).agg(F.array_sort(F.collect_list(col)).alias("items"))
    return few.join(df.groupBy(F.col(by).alias("_by")).agg(F.count(F.lit(1)).alias("total")), F.col(by).eqNullSafe(F.col("_by"))).drop("_by")


def first_of(items: Column, n: int = 5, total: Column | None = None) -> Column:
    """The first n texts of a list by line, and how many more there are of all (`total`, where the list is only the first)."""
    total = F.size(items) if total is None else total
    more = F.when(total > n, F.concat(F.lit("\n…and "), (total - n).cast("string"), F.lit(" more"))).otherwise("")
    return F.concat(F.array_join(F.slice(items, 1, n), "\n"), more)
