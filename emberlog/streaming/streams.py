"""The same predicates and aggregations on Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from emberlog.functions.predicates import name_of, search, text_of
from emberlog.operators.aggregate import measure
from emberlog.operators.alerts import Rule, condition
from emberlog.operators.paging import page, unsent
from emberlog.schema import LOGS


def read_logs_stream(spark: SparkSession, path: str, per_batch: int = 1000) -> DataFrame:
    """Stored logs as a stream of files."""
    return spark.readStream.schema(LOGS).option("maxFilesPerTrigger", per_batch).parquet(path)


def write_in_order(df: DataFrame, path: str, files: int | None = None) -> None:
    """Stored logs for read_logs_stream, each file later than the one before it, so that no batch brings rows that an earlier one's watermark has passed.

    Batches take files by time of change, which is therefore set in the files' order.
    """
    spark = df.sparkSession
    (df.repartitionByRange(files, "ts") if files else df.repartitionByRange("ts")).sortWithinPartitions("ts").write.parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = sorted(f.getPath().toString() for f in fs.listStatus(folder) if f.getPath().getName().startswith("part-"))  # a name per file
    now = max((fs.getFileStatus(spark._jvm.org.apache.hadoop.fs.Path(n)).getModificationTime() for n in names), default=0)
    for k, name in enumerate(names):
        fs.setTimes(spark._jvm.org.apache.hadoop.fs.Path(name), now - 1000 * (len(names) - k), -1)


def tail_files(spark: SparkSession, folder: str, *, per_batch: int = 1000) -> DataFrame:
    """Lines (value, file) of files as they are closed; a file that grows in place isn't read again."""
    return spark.readStream.option("maxFilesPerTrigger", per_batch).text(folder).select("value", F.col("_metadata.file_path").alias("file"))


def tail(stream: DataFrame, filters: Iterable = (), terms: Iterable[str] = ()) -> DataFrame:
    return search(stream, filters, terms)


def backfill(history: DataFrame, filters: Iterable = (), terms: Iterable[str] = (), n: int = 50) -> DataFrame:
    """The last n matches, oldest first."""
    return page(search(history, filters, terms), n).orderBy("ts", "id")


def backfill_then_tail(history: DataFrame, stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, filters: Iterable = (), terms: Iterable[str] = (), n: int = 50) -> StreamingQuery:
    """Gives the last matches to sink as batch -1, then new ones; each id once."""
    filters, terms = list(filters), list(terms)
    sent = backfill(history, filters, terms, n)
    sink(sent, -1)
    return tail(stream, filters, terms).writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda batch, k: sink(unsent(batch, sent), k)).start()


def follow(history: DataFrame, stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, filters: Iterable = (), terms: Iterable[str] = (), n: int = 50) -> StreamingQuery:
    """Gives the last matches of history to sink as batch -1, then what comes after it; ids sort by the time of receipt.

    Where history ends is kept with the checkpoint, so that a restart gives neither history again nor leaves out what came in between.
    """
    spark, filters, terms = history.sparkSession, list(filters), list(terms)
    seam = f"{checkpoint}-seam"
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{seam}/_SUCCESS")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        end = history.agg(F.max("id").alias("id"))
        sink(backfill(history, filters, terms, n), -1)
        end.coalesce(1).write.mode("overwrite").parquet(seam)
    last = spark.read.schema("id string").parquet(seam).first()
    live = tail(stream, filters, terms)
    live = live.where(F.col("id") > last.id) if last is not None and last.id is not None else live
    return live.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()


def dedupe_batches(stream: DataFrame, minutes: int = 10) -> DataFrame:
    """Rows (batch_id, line_no, received_at, ...) without retries of a batch within so many minutes; null and empty ids pass."""
    named = stream.where("batch_id <> ''").withWatermark("received_at", f"{minutes} minutes").dropDuplicatesWithinWatermark(["batch_id", "line_no"])
    return named.union(stream.where("batch_id is null or batch_id = ''").select(*named.columns))


def ingest(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes each micro-batch to a folder of its own, so that a replay replaces it."""

    def write(batch: DataFrame, k: int) -> None:
        batch.withColumn("dt", F.to_date("ts")).write.mode("overwrite").partitionBy("dt").parquet(f"{path}/ingest_batch={k}")

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def stream_timechart(stream: DataFrame, measures: Iterable[tuple], span: str = "1 minute", by: str | None = None, watermark: str = "10 minutes") -> DataFrame:
    """A time chart whose buckets are emitted once the watermark has passed them."""
    keys = [text_of(by).alias(name_of(by))] if by else []
    out = stream.withWatermark("ts", watermark).groupBy(F.window("ts", span).alias("w"), *keys).agg(*[measure(*m) for m in measures])
    return out.withColumn("bucket", F.col("w.start")).drop("w")


def stream_rule(stream: DataFrame, rule: Rule, watermark: str = "10 minutes") -> DataFrame:
    """A rule as a hopping window [start, end): (at, keys, value, firing) for each window that has rows."""
    rule.validate()
    keys = [text_of(f).alias(name_of(f)) for f in rule.by]
    hops = F.window("ts", f"{rule.window_s} seconds", f"{rule.interval_s} seconds").alias("w")
    out = search(stream, rule.filters, rule.terms).withWatermark("ts", watermark).groupBy(hops, *keys).agg(measure(*rule.measure).alias("v"))
    value = F.col("v").cast("double")
    return out.select(F.lit(rule.id).alias("rule_id"), F.col("w.end").alias("at"), *[F.col(f"`{name_of(f)}`") for f in rule.by], value.alias("value"), condition(value, rule.op, rule.value).alias("firing"))


STATES = "rule_id string, at timestamp, state string, notify boolean"


def alert_state_stream(evaluations: DataFrame) -> DataFrame:
    """(rule_id, at, state, notify) of a stream of (rule_id, at, firing, error), the state of a rule kept between batches."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        before = state.get[0] if state.exists else ""
        rows = pd.concat(list(batches)).sort_values("at")
        out = []
        for at, firing, error in zip(rows["at"], rows["firing"], rows["error"], strict=True):
            now = "unknown" if error is not None and error == error else "firing" if firing else "ok"
            out.append((key[0], at, now, (now == "firing" and before != "firing") or (now == "ok" and before == "firing")))
            before = now
        state.update((before,))
        yield pd.DataFrame(out, columns=["rule_id", "at", "state", "notify"])

    return evaluations.groupBy("rule_id").applyInPandasWithState(step, STATES, "state string", "append", "NoTimeout")


def allowed_stream(requests: DataFrame, rate: float, burst: float | None = None) -> DataFrame:
    """(key, ts, allowed) of a stream of (key, ts): a token bucket per key, kept between batches."""
    from emberlog.operators.admission import Bucket

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        bucket = Bucket(rate, burst)
        if state.exists:
            bucket.left, bucket.last = state.get
        rows = pd.concat(list(batches)).sort_values("ts")
        seconds = rows["ts"].astype("datetime64[us]").astype("int64") / 1e6
        allowed = [bucket.take(t) for t in seconds]
        state.update((bucket.left, bucket.last))
        yield pd.DataFrame({"key": key[0], "ts": rows["ts"], "allowed": allowed})

    return requests.groupBy("key").applyInPandasWithState(step, "key string, ts timestamp, allowed boolean", "left double, last double", "append", "NoTimeout")


def run_to_table(stream: DataFrame, name: str, mode: str = "append") -> StreamingQuery:
    """Runs what is there into the in-memory table `name`: for tests and small results."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def now_utc() -> datetime:
    from datetime import UTC

    return datetime.now(UTC)
