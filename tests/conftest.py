from __future__ import annotations

import sys
from datetime import UTC, datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    conf = {"spark.sql.shuffle.partitions": "4", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false", "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))}
    session = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


BASE = datetime(2026, 6, 14, 15, tzinfo=UTC)


@pytest.fixture(scope="session")
def make_logs(spark):
    """Logs of (id, minutes, service, source, level, message, JSON of attributes)."""

    def make(rows, raw=""):
        df = spark.createDataFrame([(i, BASE + timedelta(minutes=m), sv, so, lv, ms, at) for i, m, sv, so, lv, ms, at in rows], "id string, ts timestamp, service string, source string, level string, message string, a string")
        return df.select("id", "ts", F.col("ts").alias("received_at"), "source", "service", "level", "message", F.from_json("a", "map<string,variant>").alias("attributes"), F.lit(raw).alias("raw"))

    return make
