"""JSON arrays and values over lines: as the rules say, however files are split into blocks."""

from __future__ import annotations

import gzip
import json
import random
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from emberlog.functions import scalars as S
from emberlog.sources import json_blocks, readers

NOW = datetime(2026, 6, 14, 12, tzinfo=UTC)
#: body, messages that are accepted, number of rejects
BODIES = [
    ('[{"message":"good one"},{"message":"good two"},{oops}]', ["good one", "good two"], 1),
    ("{\n  \"service\": \"api\",\n  \"message\": \"hi\"\n}", ["hi"], 0),
    ("[\n  {\"message\":\"a\"},\n  {\"message\":\"b\"}\n]", ["a", "b"], 0),
    ('{"message":"hi"}', ["hi"], 0),
    ("{\n \"message\": \"a\"\n}\n{\n \"message\": \"b\"\n}", ["a", "b"], 0),
    ("{\n \"message\": \"a\"\n}\n{\"message\":\"b\"}", ["a", "b"], 0),
    ('{"message":"a"}\nnot-json\n{"message":"b"}', ["a", "b"], 1),
    ('{"message":"a"}\n{"message":', ["a"], 1),
    ('{"message":"a"}\n\n\n{"message":"b"}\n', ["a", "b"], 0),
    ("", [], 0), ("  \n\t", [], 0), ("[]", [], 0), (" [ ] ", [], 0), ("[", [], 0),
    ("\ufeff[{\"message\":\"a\"}]", [], 1),
    ('[{"message":"a"}', ["a"], 0), ('[{"message":"a"},', ["a"], 1), ('[{"message":"a"},]', ["a"], 1), ("[,]", [], 1),
    ('[{"message":"a"}, 3, null, "x", {"message":"b"}] {"message":"after"} ]}', ["a", "b"], 3),
    ('[{"message":"a"} {"message":"b"}]', ["a"], 1),
    ('[{"message":"a"}},{"message":"b"}]', ["a"], 0),
    ('[{"message":"[}\\"]{\\\\"},{"message":"b","x":{"y":[{"z":"}"}]}}]', ['[}"]{\\', "b"], 0),
    ('{"message":"a"}{"message":"b"}\n{"message":"c"} junk\n{"message":"d"}', ["d"], 2),
    ('{broken\n{"message":"c"}\n{"message":\n"d"\n}\n}\n{"message":"e"}', ["c", "d", "e"], 2),
    ('{"message":"open\n{"message":"c"}\n', ["c"], 1),
    ('{"message":"a"}\n[1,\n2]\n"x"\n{"message":"b"}', ["a", "b"], 2),
    ('{"message":"é😀}"}\n{"message":"b\\u007d"}\n', ["é😀}", "b}"], 0),
]


def read(spark, path, **options):
    logs, rejects = readers.read_json(spark, str(path), now=NOW, **options)
    return sorted(r.message for r in logs.collect()), rejects.count(), sorted(r.id for r in logs.collect())


@pytest.mark.parametrize("block", [1 << 27, 13])
def test_bodies(spark, tmp_path, block):
    """Each body in a file of its own, all at once, and the same in blocks of a few bytes."""
    for k, (body, _, _) in enumerate(BODIES):
        (tmp_path / f"{k:02} file.json").write_bytes(body.encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(block))
        spark.conf.set("spark.sql.files.openCostInBytes", "0" if block < 100 else cost)
        found = json_blocks.read_values(spark, str(tmp_path), max_bytes=1000)
        if block < 100:
            assert json_blocks._rows(spark, str(tmp_path)).select("file", "start").distinct().count() > len(BODIES)
        logs, rejects = readers.parse_lines(found, now=NOW)
        got, refused = {}, {}
        name = F.regexp_extract("file", r"(\d+)%20file", 1).cast("int")
        rows = found.withColumn("k", name).collect()
        bad = rejects.withColumn("k", name).groupBy("k").count().collect()
        refused, accepted = {r.k: r["count"] for r in bad}, sorted(r.message for r in logs.collect())
        for r in rows:
            got.setdefault(r.k, []).append((r.line_no, r.value, r.error))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.set("spark.sql.files.openCostInBytes", cost)
    for k, (body, messages, n) in enumerate(BODIES):
        mine = []
        for _, value, error in sorted(got.get(k, [])):
            try:
                mine.append(json.loads(value)["message"] if error is None else None)
            except (ValueError, TypeError):
                pass
        assert [m for m in mine if m is not None] == messages, (body, got.get(k))
        assert refused.get(k, 0) == n, (body, got.get(k))
    assert accepted == sorted(m for _, ms, _ in BODIES for m in ms)


@pytest.mark.parametrize("form", ["array", "values"])
def test_blocks_are_as_one(spark, tmp_path, form):
    """A file over many blocks gives the rows, places and ids of one block; packed files too."""
    r = random.Random(7)
    records = [{"message": "".join(r.choice('ab"\\{}[],:\n é') for _ in range(r.randint(0, 40))) + f"#{k}", "x": {"y": [k, {"z": "}"}]}} for k in range(3000)]
    text = "[" + ",\n".join(json.dumps(x, indent=r.choice((None, 1)), ensure_ascii=False) for x in records) + "]" if form == "array" else "\n".join(json.dumps(x, indent=r.choice((None, 1)), ensure_ascii=False) for x in records)
    (tmp_path / "a.json").write_text(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    whole = read(spark, tmp_path)
    assert whole[:2] == (sorted(x["message"] for x in records), 0)
    try:
        for size in (70, 5000, 40_000):
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
            if size == 70:
                (tmp_path / "small").mkdir()
                cut = json.dumps(records[:40], ensure_ascii=False) if form == "array" else "\n".join(json.dumps(x, ensure_ascii=False) for x in records[:40])
                (tmp_path / "small" / "b.json").write_text(cut)
                assert read(spark, tmp_path / "small")[0] == sorted(x["message"] for x in records[:40])
            else:
                assert read(spark, tmp_path / "a.json") == whole
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    (tmp_path / "packed").mkdir()
    (tmp_path / "packed" / "a.json.gz").write_bytes(gzip.compress(text.encode()))
    assert read(spark, tmp_path / "packed")[:2] == whole[:2]


@pytest.mark.parametrize("form", ["array", "values"])
def test_long_and_broken(spark, tmp_path, form):
    """A record that is too long is one reject, which tasks don't hold; a break far into a file ends an array, and costs values one line."""
    rows = [json.dumps({"message": f"m{k}"}) for k in range(2000)]
    rows[700] = json.dumps({"message": "x" * 50_000})
    array = form == "array"
    (tmp_path / "a.json").write_text("[" + ",".join(rows) + "]" if array else "\n".join(rows))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (before, "4000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            messages, rejects, _ = read(spark, tmp_path / "a.json", max_bytes=1000)
            assert len(messages) == 1999 and rejects == 1
        rows[1200] = '{"message": tru}'
        (tmp_path / "b.json").write_text("[" + ",".join(rows) + "]" if array else "\n".join(rows))
        for size in (before, "4000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            messages, rejects, _ = read(spark, tmp_path / "b.json", max_bytes=1000)
            assert (len(messages), rejects) == ((1199, 2) if array else (1998, 2))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_groups_of_files(spark, tmp_path, monkeypatch):
    """More blocks than are held at once are composed by groups of files."""
    for k in range(7):
        (tmp_path / f"{k}.json").write_text(f'[{{"message":"a{k}"}},{{"message":"b{k}"}}]' if k % 2 else f'{{"message":"a{k}"}}\nbad\n{{"message":"b{k}"}}')
    monkeypatch.setattr(json_blocks, "FEW", 2)
    assert read(spark, tmp_path)[:2] == (sorted(x + str(k) for k in range(7) for x in "ab"), 4)


def test_one_value_and_no_more(spark):
    rows = ['{"a":1}', ' {"a":1}\n', "3", '"x"', "null", "[]", '{"a":1} junk', '{"a":1}{"b":2}', '{"a":1},{"b":2}', "1],[2", "1],", '{"a":1}],[', "", " ", None, "[1", '{"a":NaN}']
    got = spark.createDataFrame([(k, v) for k, v in enumerate(rows)], "k int, v string").select("k", S.json_value(F.col("v")).isNotNull().alias("ok")).collect()
    assert [r.k for r in sorted(got) if r.ok] == [0, 1, 2, 3, 4, 5]


def test_files_are_cut_once(spark, tmp_path):
    """What is taken and what is rejected come from values that were cut and parsed once, not from files read again; a broken file has a task of its own."""
    for k in range(5):  # one more than tasks of a shuffle
        (tmp_path / f"bad{k}.json").write_text('{"a":\n1}\nno json\n{"b": "}"}\n')
    (tmp_path / "array.json").write_text('[{"a": 1}, {"b": 2}, {oops}, {"c": 3}]')
    (tmp_path / "good.json").write_text('{"a":\n1}\n{"b": 2}\n')
    found = json_blocks.read_values(spark, str(tmp_path), max_bytes=1000)
    leaves = found._jdf.queryExecution().withCachedData().collectLeaves()
    assert {leaves.apply(k).nodeName() for k in range(leaves.size())} <= {"InMemoryRelation", "LogicalRDD", "LocalRelation"}
    rows = found.select(F.element_at(F.split("file", "/"), -1).alias("name"), "value", "error", F.spark_partition_id().alias("task")).collect()
    bad = {}
    for r in rows:
        if r.name.startswith("bad"):
            bad.setdefault(r.task, set()).add(r.name)
    assert len(bad) == 5 and all(len(names) == 1 for names in bad.values())
    assert sorted(r.value for r in rows if r.name == "bad3.json") == ['no json', '{"a":\n1}', '{"b": "}"}']
    assert sorted((r.value.strip(), r.error) for r in rows if r.name == "array.json") == [('{"a": 1}', None), ('{"b": 2}', None), ("{oops}", "invalid JSON array")]
    assert sorted(r.value for r in rows if r.name == "good.json") == ['{"a":\n1}', '{"b": 2}']


def test_packed_lines_are_dealt_out(spark, tmp_path):
    """A packed file is read by one task; its lines are parsed by others, with the ids that their places give."""
    with gzip.open(tmp_path / "a.gz", "wt") as f:
        f.write("\n".join(json.dumps({"msg": f"m{k % 7}", "n": k}) for k in range(400)) + "\n\nno json\n")
    logs, rejects = readers.read_ndjson(spark, str(tmp_path), now=datetime(2024, 3, 1, tzinfo=UTC))
    assert "RepartitionByExpression [file" in logs._jdf.queryExecution().optimizedPlan().toString()
    rows = logs.select("id", S.attr_text(S.attr("n")).cast("int").alias("n"), "message").collect()
    assert sorted((r.n, r.message) for r in rows) == [(k, f"m{k % 7}") for k in range(400)] and len({r.id for r in rows}) == 400
    assert [(r.value, r.reason) for r in rejects.collect()] == [("no json", "not a JSON object")]
    again = readers.read_ndjson(spark, str(tmp_path), now=datetime(2024, 3, 1, tzinfo=UTC))[0]
    assert {r.id for r in again.select("id").collect()} == {r.id for r in rows}
