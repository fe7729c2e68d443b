"""Sources: JSON lines, arrays and multi-line values, raw text, and the merge of all of them."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberlog.functions import scalars as S
from emberlog.functions.scalars import event_id
from emberlog.operators.normalize import normalize
from emberlog.schema import COLUMNS
from emberlog.sources.json_blocks import PACKED, read_values

MAX_BYTES = 1 << 20
RECORD = "map<string,variant>"


def _refuse_long(max_bytes: int):
    return F.when(F.octet_length("value") > max_bytes, F.lit(f"record longer than {max_bytes} bytes"))


def parse_lines(lines: DataFrame, *, now: datetime, max_bytes: int = MAX_BYTES) -> tuple[DataFrame, DataFrame]:
    """(logs, rejects) of a column `value` with a JSON object in each row, and of `error`, what is wrong with it, where a reader found that out."""
    given = set(lines.columns)
    refused = F.coalesce(F.col("error"), _refuse_long(max_bytes)) if "error" in given else _refuse_long(max_bytes)
    lines = S.once(S.placed(lines), "_json", F.struct(F.when(refused.isNull(), S.json_value(F.col("value"))).alias("v")))
    parsed = F.col("_json.v")
    record = F.when(F.schema_of_variant(parsed).startswith("OBJECT"), F.try_variant_get(parsed, "$", RECORD))
    logs, rejects = normalize(lines.withColumns({"error": refused, "record": record}).drop("_json"), now=now)
    return logs, rejects.drop(*({"file", "line_no"} - given))


FEW = 100_000  # blocks of files whose line numbers are sent to all tasks


def numbered(df: DataFrame) -> DataFrame:
    """df, read straight from text files, with `file` and `line_no`, the number of a row in its file however files are split.

    Blocks are counted first, a row each; a row's number is that of its block's first row and its place in the block.
    """
    spark = df.sparkSession
    block = {"file": F.col("_metadata.file_path"), "_start": F.col("_metadata.file_block_start"), "_at": F.monotonically_increasing_id()}
    placed = df.withColumns(block)
    blocks = placed.groupBy("file", "_start").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    found = blocks.limit(FEW + 1).collect()
    if len(found) <= FEW:
        out, file, lines = [], None, 0
        for r in sorted(found, key=lambda r: (r.file, r["_start"])):
            file, lines = r.file, lines if r.file == file else 0
            out.append((r.file, r["_start"], r["_first"], r["_n"], lines))
            lines += r["_n"]
        bases = F.broadcast(spark.createDataFrame(out, "file string, _start long, _first long, _n long, _base long"))
    else:
        before = Window.partitionBy("file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
        bases = blocks.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    away = F.col("_at") - F.col("_first")
    line_no = F.when(away.between(0, F.col("_n") - 1), F.col("_base") + away).otherwise(F.raise_error(F.lit("files changed while they were read")))
    return placed.join(bases, ["file", "_start"]).withColumn("line_no", line_no).drop("_start", "_at", "_first", "_n", "_base")


def read_ndjson(spark: SparkSession, path: str, *, now: datetime, max_bytes: int = MAX_BYTES) -> tuple[DataFrame, DataFrame]:
    """One object a line; .gz and .deflate are decompressed. Blank lines are skipped.

    A packed file is read by one task, so its lines are dealt out before they are parsed; they have their places by then.
    """
    files = spark.read.text(path)
    lines = numbered(files).where(F.trim("value") != "")
    if any(f.lower().endswith(PACKED) for f in files.inputFiles()):
        lines = lines.repartition("file", "line_no")
    return parse_lines(lines, now=now, max_bytes=max_bytes)


def read_json(spark: SparkSession, path: str, *, now: datetime, max_bytes: int = MAX_BYTES) -> tuple[DataFrame, DataFrame]:
    """Files of any size that hold an array of objects each, or objects one after another that may span lines; see `json_blocks`."""
    return parse_lines(read_values(spark, path, max_bytes=max_bytes), now=now, max_bytes=max_bytes)


read_json_array = read_json_multiline = read_json


def of_raw(lines: DataFrame, service: str, source: str, level: str = "info", *, now: datetime) -> DataFrame:
    """One event a line of the column `value`; ids follow from its place, see `S.placed`."""
    line = F.regexp_replace("value", r"\r$", "")
    rows = S.placed(lines).withColumn("line", line).where(F.trim("line") != "")
    at = F.lit(now).cast("timestamp")
    return rows.select(event_id(at, F.col("file"), F.col("line_no"), F.col("line")).alias("id"), at.alias("ts"), at.alias("received_at"), F.lit(source).alias("source"), F.lit(service).alias("service"), F.lit(level).alias("level"), F.col("line").alias("message"), F.create_map().cast(RECORD).alias("attributes"), F.col("line").alias("raw"))


def read_raw(spark: SparkSession, path: str, service: str, source: str, level: str = "info", *, now: datetime) -> DataFrame:
    return of_raw(numbered(spark.read.text(path)), service, source, level, now=now)


def merge_logs(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).select(*COLUMNS)
