"""What large inputs pay for: texts of records are found once, and segments of an index are neither sampled nor dealt by ranges."""

from __future__ import annotations

from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from emberlog.operators import index as I
from emberlog.operators import sinks as K
from emberlog.operators.normalize import normalize
from tests.conftest import BASE


def test_types_are_not_asked_for_texts(spark):
    rows = [('{"msg": {"a": [1, "x"]}, "lvl": " ERR ", "time": "2026-06-14T15:00:00Z"}', "ok"), ('{"msg": true, "level": 4, "time": " "}', "ok"), ('{"msg": null, "level": "what", "time": 1.7e9, "raw": 2.50}', "ok"), ('{"time": true}', "bad"), ('{"time": {"a": 1}}', "bad"), ('{"time": "soon"}', "bad"), ('{"time": null, "level": [1]}', "ok")]
    df = spark.createDataFrame(rows, "value string, want string").withColumn("record", F.try_variant_get(F.try_parse_json("value"), "$", "map<string,variant>"))
    logs, rejects = normalize(df, now=BASE)
    got = sorted((r.message, r.level, str(r.ts), r.raw) for r in logs.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm")).collect())
    assert got == sorted([('{"a":[1,"x"]}', "error", "2026-06-14 15:00", ""), ("true", "warn", "2026-06-14 15:00", ""), ("", "info", "2023-11-14 22:13", "2.5"), ("", "info", "2026-06-14 15:00", "")])
    assert sorted(r.value for r in rejects.collect()) == sorted(v for v, want in rows if want == "bad") and {r.reason for r in rejects.collect()} == {"invalid timestamp"}
    assert "schema_of_variant" not in logs._jdf.queryExecution().optimizedPlan().toString().lower().replace("schemaofvariant", "schema_of_variant")


def test_segments_without_ranges(spark, make_logs, tmp_path, monkeypatch):
    def refuse(*_):
        pytest.fail("postings dealt by ranges")

    monkeypatch.setattr(type(spark.range(1)), "repartitionByRange", refuse)
    path = str(tmp_path / "logs")
    for batch in ("1", "2"):
        df = make_logs([(f"{batch if k else 'both'}-{k}", k, "s", "h", "info", f"red dog {batch} {k}", "{}") for k in range(20)])
        K.write_logs(df.withColumn("received_at", F.lit(BASE + timedelta(seconds=int(batch))).cast("timestamp")), path, batch)
        I.index_batch(spark, path, batch)
    K.compact(spark, path)
    (name, held), = I._last(spark, path)[1].items()
    kept = spark.read.schema(I.POSTING).parquet(f"{path}/_index/{name}").withColumn("file", F.input_file_name()).withColumn("at", F.monotonically_increasing_id())
    assert set(held) == {"1", "2"}
    assert kept.where("id = 'both-0' and ingest_batch = '1'").count() == 0 and kept.where("token = 'dog'").count() == 39
    for file, rows in ((f.file, kept.where(F.col("file") == f.file).orderBy("at").collect()) for f in kept.select("file").distinct().limit(2).collect()):
        assert [r.token for r in rows] == sorted(r.token for r in rows), file
    assert I.search_stored(spark, path, terms=["red dog 1"]).count() == 19
