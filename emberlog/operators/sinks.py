"""Writing logs, exports and rejects."""

from __future__ import annotations

import json
import re
import uuid
from collections import Counter
from collections.abc import Iterable
from dataclasses import asdict, dataclass, field, replace
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlog.functions.scalars import ABSENT, TYPED, attr, attr_text, csv_safe, real
from emberlog.functions.text import text_norm
from emberlog.operators.paging import latest_by_id, order_of, ordered
from emberlog.schema import LOGS


def frequent_keys(df: DataFrame, most: int = 8, share: float = 0.2) -> list[str]:
    """The keys of attributes that at least such a share of the rows have, the most frequent ones first."""
    n = df.count()
    keys = df.select(F.explode(F.map_keys("attributes")).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return [r.key for r in keys.where(F.col("n") >= share * n).orderBy(F.desc("n"), "key").limit(most).collect()]


def with_typed(df: DataFrame, keys: Iterable[str]) -> DataFrame:
    """df with the attributes of these keys as columns too, which filters on them can skip files and row groups by."""
    for key in keys:
        text = attr_text(attr(key))
        held = F.when(text.isNull(), ABSENT).when(text.startswith(ABSENT), F.concat(F.lit(ABSENT), text)).otherwise(text)
        df = df.withColumns({f"{TYPED}{key}": held, f"{TYPED}{key}#": real(text)})
    return df


def write_logs(df: DataFrame, path: str, batch_id: str, *, text: bool = False, typed: Iterable[str] | int = ()) -> None:
    """One batch, by day; the same batch written again replaces itself. text: with text_norm, which searches then use.

    Rows are sorted by day first, as the writer needs them: it puts a sort by day in the place of any other.
    typed: keys of attributes that get columns of their own, with Bloom filters; a number takes that many of the most frequent.
    """
    df = df.withColumn("text_norm", text_norm()) if text else df
    keys = frequent_keys(df, typed) if isinstance(typed, int) else list(typed)
    options = {f"parquet.bloom.filter.enabled#{TYPED}{k}": "true" for k in keys}
    with_typed(df, keys).withColumn("dt", F.to_date("ts")).sortWithinPartitions("dt", "service", "ts").write.options(**options).mode("overwrite").partitionBy("dt").parquet(f"{path}/ingest_batch={batch_id}")


# A store is a folder of batches (ingest_batch=<id>/dt=<day>) and of compacted rows (base=<generation>/dt=<day>). A version, a
# small file in _versions, names the folder that holds each compacted day and the batches that it holds, by the ids that
# Spark gives the files of a write. Readers take the last version: a batch that it holds is passed over, whatever is
# left of its folder, unless it was written again since, and then it is a batch of its own number.


@dataclass
class Version:
    """number: 0 before the first; days: folder of each compacted day; held: ids of the writes of each batch in them; schema: of the compacted rows."""

    number: int = 0
    days: dict[str, str] = field(default_factory=dict)
    held: dict[str, list[str]] = field(default_factory=dict)
    schema: str | None = None


def _filesystem(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs
    return hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, hadoop = _filesystem(spark, path)
    return [f.getPath().getName() for f in fs.listStatus(hadoop.Path(path))] if fs.exists(hadoop.Path(path)) else []


def last_version(spark: SparkSession, path: str) -> Version:
    numbers = [int(m[1]) for n in _names(spark, f"{path}/_versions") if (m := re.fullmatch(r"(\d+)\.json", n))]
    if not numbers:
        return Version()
    fs, hadoop = _filesystem(spark, path)
    stream = fs.open(hadoop.Path(f"{path}/_versions/{max(numbers):012}.json"))
    try:
        return Version(**json.loads(bytes(stream.readAllBytes())))
    finally:
        stream.close()


def _commit(spark: SparkSession, path: str, version: Version) -> None:
    """Makes a version the last one, by the rename of a whole file; another of that number is an error."""
    fs, hadoop = _filesystem(spark, path)
    target, temporary = hadoop.Path(f"{path}/_versions/{version.number:012}.json"), hadoop.Path(f"{path}/_versions/_{uuid.uuid4().hex}")
    out = fs.create(temporary)
    out.write(bytearray(json.dumps(asdict(version)).encode()))
    out.close()
    if fs.exists(target) or not fs.rename(temporary, target):
        raise RuntimeError(f"version {version.number} of {path} was written by another run")


def _files(spark: SparkSession, folder: str) -> list[tuple[str, str, int]]:
    """(day, id of its write, bytes) of each file of a batch or base."""
    fs, hadoop = _filesystem(spark, folder)
    found, files = [], fs.listFiles(hadoop.Path(folder), True)
    while files.hasNext():
        f = files.next()
        at = f.getPath()
        if (m := re.match(r"part-\d+-([0-9a-f-]{36})", at.getName())) and (d := re.fullmatch(r"dt=(.+)", at.getParent().getName())):
            found.append((d[1], m[1], f.getLen()))
    return found


def _batches(spark: SparkSession, path: str, version: Version) -> dict[str, list[tuple[str, str, int]]]:
    """The files of each batch that the version doesn't hold; of batches without files none."""
    out = {}
    for name in _names(spark, path):
        if name.startswith("ingest_batch="):
            batch = name.removeprefix("ingest_batch=")
            files = _files(spark, f"{path}/{name}")
            if files and not {write for _, write, _ in files} & set(version.held.get(batch, ())):
                out[batch] = files
    return out


def _empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], LOGS).withColumns({"dt": F.to_date("ts"), "ingest_batch": F.lit(None).cast("string")})


def _read_base(spark: SparkSession, path: str, version: Version) -> DataFrame | None:
    if not version.days:
        return None
    schema = T.StructType.fromJson(json.loads(version.schema)).add("base", "string").add("dt", "date")
    folders = [f"{path}/{folder}/dt={day}" for day, folder in sorted(version.days.items())]
    return spark.read.schema(schema).option("basePath", path).parquet(*folders).drop("base")


def _read_batches(spark: SparkSession, path: str, batches: Iterable[str]) -> DataFrame | None:
    folders = [f"{path}/ingest_batch={b}" for b in sorted(batches)]
    if not folders:
        return None
    reader = spark.read.option("basePath", path)
    kinds = {"ingest_batch": T.StringType(), "dt": T.DateType()}  # not what their names look like
    schema = T.StructType([T.StructField(f.name, kinds.get(f.name, f.dataType)) for f in reader.option("mergeSchema", "true").parquet(*folders).schema])
    return reader.schema(schema).parquet(*folders)


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """The current row of each id over all batches: the one received last, of equals that of the later batch.

    Compacted rows have their ids once and only give way to those of other batches, so that a filter reaches their files.
    """
    version = last_version(spark, path)
    return _current(spark, path, version, _batches(spark, path, version))


FEW_IDS = 100_000  # ids of batches above which they aren't sent to all tasks, whatever the size of their files lets Spark expect


def _ids(new: DataFrame) -> DataFrame:
    """(_id) of batches, to join with; their rows are counted from the files' footers."""
    ids = new.select(F.col("id").alias("_id")).distinct()
    return ids if new.count() <= FEW_IDS else ids.hint("merge")


def _current(spark: SparkSession, path: str, version: Version, batches: dict) -> DataFrame:
    base, new = _read_base(spark, path, version), _read_batches(spark, path, batches)
    if new is None:
        return base if base is not None else _empty(spark)
    if base is None:
        return latest_by_id(new, "ingest_batch")
    # a batch that was written again takes the place of what the base has of it
    base = base.where(~F.concat("ingest_batch", F.lit("")).isin(sorted(batches)))  # not a filter that files could skip anything by
    ids = _ids(new)
    alone = base.join(ids, F.col("id") == F.col("_id"), "left_anti")
    met = base.join(ids, F.col("id") == F.col("_id"), "left_semi")
    return alone.unionByName(latest_by_id(met.unionByName(new, allowMissingColumns=True), "ingest_batch"), allowMissingColumns=True)


def compact(spark: SparkSession, path: str, file_mb: int = 256) -> None:
    """Puts batches into the base, each id once: only days that they change are written, into files of about file_mb MB.

    Batches and days that the new version no longer reads stay until the next compaction, for readers of the one before.
    Segments of an index become one.
    """
    from emberlog.operators.index import forget_changed, merge_index

    version = last_version(spark, path)
    batches = _batches(spark, path, version)
    _clean(spark, path, version)
    if not batches:
        return
    indexed = bool(_names(spark, f"{path}/_index"))
    if indexed:
        forget_changed(spark, path)
    base, new = _read_base(spark, path, version), _read_batches(spark, path, batches)
    changed = new.select("dt")
    if base is not None:  # days that an id, or the row of a batch written again, leaves
        gone = base.where(F.col("ingest_batch").isin(sorted(batches))).select("dt")
        changed = changed.unionByName(base.join(_ids(new), F.col("id") == F.col("_id"), "left_semi").select("dt")).unionByName(gone)
    days = {str(r.dt) for r in changed.distinct().collect()}  # a row per day
    sizes: Counter = Counter()
    for folder in (*(f"{path}/ingest_batch={b}" for b in batches), *(f"{path}/{f}" for f in sorted(set(version.days.values())))):
        for day, _, n in _files(spark, folder):
            sizes[day] += n
    pieces = spark.createDataFrame([(date.fromisoformat(d), 1 + sizes[d] // (file_mb << 20)) for d in sorted(days)], "dt date, pieces int")
    old = Version(version.number, {d: f for d, f in version.days.items() if d in days}, version.held, version.schema)
    rows = _current(spark, path, old, batches).where(F.col("dt").isin([date.fromisoformat(d) for d in days]))
    rows = rows.join(F.broadcast(pieces), "dt").withColumn("piece", F.pmod(F.xxhash64("id"), F.col("pieces")))
    rows = rows.repartition("dt", "piece").sortWithinPartitions("dt", "service", "ts").drop("pieces", "piece")
    folder = f"base={version.number + 1}"
    options = {f"parquet.bloom.filter.enabled#{c}": "true" for c in rows.columns if c.startswith(TYPED) and not c.endswith("#")}
    rows.write.options(**options).mode("overwrite").partitionBy("dt").parquet(f"{path}/{folder}")
    written = {day for day, *_ in _files(spark, f"{path}/{folder}")}
    schema = T.StructType([f for f in rows.schema if f.name != "dt"])
    if version.schema:  # columns that only days which weren't written have
        schema = T.StructType([*schema, *(f for f in T.StructType.fromJson(json.loads(version.schema)) if f.name not in schema.names)])
    held = {b: sorted({write for _, write, _ in files}) for b, files in batches.items()}
    kept = {d: f for d, f in version.days.items() if d not in days}
    _commit(spark, path, Version(version.number + 1, kept | {d: folder for d in written}, held, schema.json()))  # batches held before are deleted by now
    if indexed:
        merge_index(spark, path)


def _clean(spark: SparkSession, path: str, version: Version) -> None:
    """Deletes what the version doesn't read: batches that it holds, other days of the base, and what lost runs wrote."""
    fs, hadoop = _filesystem(spark, path)
    for name in _names(spark, path):
        if name.startswith("ingest_batch="):
            batch = name.removeprefix("ingest_batch=")
            if {write for _, write, _ in _files(spark, f"{path}/{name}")} & set(version.held.get(batch, ())):
                fs.delete(hadoop.Path(f"{path}/{name}"), True)
        elif name.startswith("base="):
            read = {d for d, f in version.days.items() if f == name}
            for day in _names(spark, f"{path}/{name}"):
                if day.removeprefix("dt=") not in read:
                    fs.delete(hadoop.Path(f"{path}/{name}/{day}"), True)
            if not read:
                fs.delete(hadoop.Path(f"{path}/{name}"), True)


def retain(df: DataFrame, days: int, now: datetime) -> tuple[DataFrame, DataFrame]:
    """(rows kept, number removed); older than the cutoff is strict, days of 0 or less keep all."""
    if days <= 0:
        return df, df.sparkSession.range(1).select(F.lit(0).cast("long").alias("removed"))
    old = F.col("ts") < F.lit(now - timedelta(days=days))
    return df.where(~old), df.agg(F.count_if(old).alias("removed"))


def purge(spark: SparkSession, path: str, days: int, now: datetime) -> int:
    """Drops old rows: whole days go, the cutoff's day is rewritten; returns the number removed.

    Of the base a new version leaves them out. In a batch a rewritten day is written beside the old one, which steps aside
    before it and is deleted after, so that a run lost in between loses no row: the next one puts back what stepped aside.
    """
    if days <= 0:
        return 0
    fs, hadoop = _filesystem(spark, path)
    cutoff = now - timedelta(days=days)
    version = last_version(spark, path)
    _clean(spark, path, version)
    removed = 0
    old = sorted(d for d in version.days if d <= str(cutoff.date()))
    if old:
        rows = _read_base(spark, path, Version(days={d: version.days[d] for d in old}, schema=version.schema))
        removed = rows.where(F.col("ts") < F.lit(cutoff)).count()
    if removed:
        folder = f"base={version.number + 1}"
        kept = {d: f for d, f in version.days.items() if d not in old}
        if str(cutoff.date()) in old:
            rows.where(F.col("ts") >= F.lit(cutoff)).write.mode("overwrite").partitionBy("dt").parquet(f"{path}/{folder}")
            kept |= {day: folder for day, *_ in _files(spark, f"{path}/{folder}")}
        _commit(spark, path, replace(version, number=version.number + 1, days=kept))
        _clean(spark, path, last_version(spark, path))
    for folder in [f.getPath().toString() for f in fs.globStatus(hadoop.Path(f"{path}/ingest_batch=*"))]:  # a batch each
        for f in fs.globStatus(hadoop.Path(f"{folder}/.old-*")):
            day = hadoop.Path(f"{folder}/dt={f.getPath().getName().removeprefix('.old-')}")
            if fs.exists(day):
                fs.delete(f.getPath(), True)
            else:
                fs.rename(f.getPath(), day)
        days_held = [f.getPath() for f in fs.globStatus(hadoop.Path(f"{folder}/dt=*"))]
        for day in days_held:
            name = day.getName().removeprefix("dt=")
            if name > str(cutoff.date()):
                continue
            rows = spark.read.parquet(day.toString())
            gone = rows.where(F.col("ts") < F.lit(cutoff)).count()
            removed += gone
            if name < str(cutoff.date()):
                fs.delete(day, True)
            elif gone:
                kept, old = hadoop.Path(f"{folder}/.kept-{name}"), hadoop.Path(f"{folder}/.old-{name}")
                rows.where(F.col("ts") >= F.lit(cutoff)).write.mode("overwrite").parquet(kept.toString())
                fs.rename(day, old)
                fs.rename(kept, day)
                fs.delete(old, True)
        if not fs.globStatus(hadoop.Path(f"{folder}/dt=*")):
            fs.delete(hadoop.Path(folder), True)
    return removed


def as_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias("value"))


def export_ndjson(df: DataFrame, path: str, order: str = "newest") -> None:
    as_json(ordered(df, order)).write.mode("overwrite").text(path)


def export_json(df: DataFrame, order: str = "newest", most: int = 10_000) -> DataFrame:
    """One row with a JSON array of `most` rows at most, in order; more are refused, and want export_json_array or export_ndjson."""
    df = df.limit(most + 1)
    rows = F.array_sort(F.collect_list(F.struct("ts", "id", F.to_json(F.struct("*")).alias("j"))))
    rows = F.reverse(rows) if order == "newest" else rows
    made = df.agg(rows.alias("rows"))
    refused = F.raise_error(F.lit(f"more than {most} rows: export them in parts"))
    return made.select(F.when(F.size("rows") > most, refused).otherwise(F.concat(F.lit("["), F.array_join(F.transform("rows", lambda r: r["j"]), ","), F.lit("]"))).alias("value"))


def export_json_array(df: DataFrame, path: str, order: str = "newest") -> None:
    """A JSON array of any size as text files in order of name: the first line opens it, later ones begin with a comma, the last file closes it."""
    spark = df.sparkSession
    hadoop, held_at = spark._jvm.org.apache.hadoop.fs, f"{path}.held"
    df.select("ts", "id", F.to_json(F.struct("*")).alias("j"), F.monotonically_increasing_id().alias("n")).write.mode("overwrite").parquet(held_at)
    held = spark.read.parquet(held_at)
    by = [*order_of(order), F.col("n")]
    first = held.orderBy(*by).select("n").first()
    start = F.when(F.col("n") == F.lit(first.n if first else 0), "[").otherwise(",")
    held.orderBy(*by).select(F.concat(start, "j").alias("value")).write.mode("overwrite").text(path)
    close = hadoop.Path(f"{path}/part-z-close.txt")
    fs = close.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(hadoop.Path(held_at), True)
    out = fs.create(close)
    out.writeBytes("]\n" if first else "[]\n")
    out.close()


def read_json_array_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The records of export_json_array."""
    lines = spark.read.text(path).where(~F.col("value").isin("]", "[]"))
    return lines.select(F.from_json(F.substr("value", F.lit(2)), schema).alias("r")).select("r.*")


def as_csv(df: DataFrame) -> DataFrame:
    """The columns of a CSV export, as text and safe for spreadsheets."""
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    stamp = F.regexp_replace(F.regexp_replace(stamp, r"0+Z$", "Z"), r"\.Z$", "Z")
    return df.select(stamp.alias("timestamp"), *[csv_safe(F.col(c)).alias(c) for c in ("level", "service", "source", "message")], csv_safe(F.to_json("attributes")).alias("attributes"))


def export_csv(df: DataFrame, path: str, order: str = "newest") -> None:
    as_csv(ordered(df, order)).write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def write_rejects(rejects: DataFrame, path: str, batch_id: str, now: datetime) -> None:
    """A batch's rejects, in a folder of their own; the same batch written again replaces itself."""
    rejects.withColumns({"batch_id": F.lit(batch_id), "rejected_at": F.lit(now)}).write.mode("overwrite").json(f"{path}/reject_batch={batch_id}")
