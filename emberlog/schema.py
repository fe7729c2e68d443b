"""The canonical event table, and its derivation from the driver's `events` table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

COLUMNS = ["id", "ts", "received_at", "source", "service", "level", "message", "attributes", "raw"]
LOGS = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("received_at", T.TimestampType()),
    T.StructField("source", T.StringType()),
    T.StructField("service", T.StringType()),
    T.StructField("level", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("attributes", T.MapType(T.StringType(), T.VariantType())),
    T.StructField("raw", T.StringType()),
])


def load_logs(spark: SparkSession, path: str) -> DataFrame:
    """Stored logs. NTZ times become timestamps (the session's zone should be UTC), which watermarks need."""
    df = spark.read.parquet(path)
    return df.withColumns({f.name: F.col(f.name).cast("timestamp") for f in df.schema if f.dataType == T.TimestampNTZType()})


def logs_of_events(events: DataFrame) -> DataFrame:
    """Logs derived from the `events` table: the type is the service, the JSON of props the attributes."""
    kind = F.col("event_type")
    level = F.when(kind == "error", "error").when(kind == "purchase", "warn").when(kind == "view", "debug").otherwise("info")
    ts = F.col("ts").cast("timestamp")
    return events.select(
        F.lpad(F.col("event_id").cast("string"), 26, "0").alias("id"),
        ts.alias("ts"),
        ts.alias("received_at"),
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("source"),
        kind.alias("service"),
        level.alias("level"),
        F.concat(kind, F.lit(" by user "), F.col("user_id").cast("string")).alias("message"),
        F.from_json("props", "map<string,variant>").alias("attributes"),
        F.lit("").alias("raw"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs_of_events(spark.read.parquet(f"{sf_dir}/events.parquet"))
