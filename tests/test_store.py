"""Stored logs: versions, lost and repeated runs, purges, rows with and without normal text, and what filters reach."""

from __future__ import annotations

import json
import re
import shutil
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from emberlog.functions import predicates as P
from emberlog.operators import pipelines as E
from emberlog.operators import sinks as K
from tests.conftest import BASE

DAY = 60 * 24


def batch(make_logs, name, ids, day=0, seconds=0):
    df = make_logs([(i, day * DAY + k, "s", "h", "info", f"{name} {i}", json.dumps({"k": k})) for k, i in enumerate(ids)])
    return df.withColumn("received_at", F.lit(BASE + timedelta(seconds=seconds)).cast("timestamp"))


def rows(spark, path):
    return sorted((r.id, r.message) for r in K.read_logs(spark, path).collect())


def test_a_compaction_lost_at_any_delete(spark, make_logs, tmp_path):
    """Whatever of the old folders is still there, files of one or of some, the rows are the same; as are they after a retry of an old batch."""
    path, kept = tmp_path / "logs", tmp_path / "kept"
    ids = [f"i{k}" for k in range(20)]
    nine, ten = batch(make_logs, "9", ids), batch(make_logs, "10", ids[:12])  # received at the same time
    K.write_logs(nine, str(path), "9")
    K.write_logs(ten, str(path), "10")
    shutil.copytree(path, kept)
    want = rows(spark, str(path))
    assert want == sorted((i, f"{10 if k < 12 else 9} {i}") for k, i in enumerate(ids))
    K.compact(spark, str(path))
    assert rows(spark, str(path)) == want and K.last_version(spark, str(path)).number == 1
    for left in ([], ["ingest_batch=9"], ["ingest_batch=10"], ["ingest_batch=9", "ingest_batch=10"]):
        for name in ("ingest_batch=9", "ingest_batch=10"):
            shutil.rmtree(path / name, ignore_errors=True)
            if name in left:
                shutil.copytree(kept / name, path / name)
                files = sorted((path / name).rglob("part-*.parquet"))
                for f in files[1:] if len(files) > 1 and len(left) == 1 else []:
                    f.unlink()
        assert rows(spark, str(path)) == want, left
    K.write_logs(nine, str(path), "9")  # a retry of what was taken long ago
    assert rows(spark, str(path)) == want
    K.compact(spark, str(path))
    assert rows(spark, str(path)) == want and not (path / "ingest_batch=10").exists()
    K.compact(spark, str(path))  # nothing new: what is held already goes
    assert rows(spark, str(path)) == want and not (path / "ingest_batch=9").exists()
    K.write_logs(batch(make_logs, "9 mended", ids[12:16]), str(path), "9")  # written again with other rows
    assert rows(spark, str(path)) == sorted([x for x in want if x[0] in ids[:12]] + [(i, f"9 mended {i}") for i in ids[12:16]])


def test_a_run_lost_before_its_version(spark, make_logs, tmp_path, monkeypatch):
    path = str(tmp_path / "logs")
    K.write_logs(batch(make_logs, "1", ["a", "b"]), path, "1")
    K.compact(spark, path)
    K.write_logs(batch(make_logs, "2", ["b", "c"], seconds=1), path, "2")
    want = rows(spark, path)
    with monkeypatch.context() as m:
        m.setattr(K, "_commit", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError, match="lost"):
            K.compact(spark, path)
    assert rows(spark, path) == want
    K.compact(spark, path)
    assert rows(spark, path) == want
    with pytest.raises(RuntimeError, match="another run"):
        K._commit(spark, path, K.last_version(spark, path))


def test_only_changed_days_are_written(spark, make_logs, tmp_path):
    """Days without news keep their files; a row that moves to another day leaves its old one; files have about the size asked for."""
    path = str(tmp_path / "logs")
    for day in range(4):
        K.write_logs(batch(make_logs, "x", [f"d{day}-{k}" for k in range(50)], day), path, str(day))
    K.compact(spark, path)
    first = K.last_version(spark, path)
    assert len(first.days) == 4 and set(first.days.values()) == {"base=1"}
    K.write_logs(batch(make_logs, "moved", ["d1-3"], 2, seconds=5), path, "9")
    want = rows(spark, path)
    K.compact(spark, path, file_mb=1)
    second = K.last_version(spark, path)
    days = sorted(second.days)
    assert [second.days[d] for d in days] == ["base=1", "base=2", "base=2", "base=1"]
    assert rows(spark, path) == want and len(want) == 200
    moved = K.read_logs(spark, path).where("id = 'd1-3'").first()
    assert str(moved.dt) == days[2] and moved.message == "moved d1-3"
    assert K.purge(spark, path, 1, BASE + timedelta(days=3)) == 99
    assert len(rows(spark, path)) == 101 and sorted(K.last_version(spark, path).days) == days[2:]


def test_a_purge_of_everything(spark, make_logs, tmp_path):
    path = str(tmp_path / "logs")
    K.write_logs(batch(make_logs, "1", ["a", "b"]), path, "1")
    K.write_logs(batch(make_logs, "2", ["c"]), path, "2")
    assert K.purge(spark, path, 1, BASE + timedelta(days=9)) == 3
    assert rows(spark, path) == [] and K.read_logs(spark, path).where("level = 'info'").count() == 0
    K.write_logs(batch(make_logs, "3", ["d"]), path, "3")
    K.compact(spark, path)
    assert K.purge(spark, path, 1, BASE + timedelta(days=9)) == 1
    assert rows(spark, path) == [] and P.search(K.read_logs(spark, path), terms=["x"]).count() == 0
    K.write_logs(batch(make_logs, "4", ["e"]), path, "4")
    assert rows(spark, path) == [("e", "4 e")]


def test_rows_with_and_without_normal_text(spark, make_logs, tmp_path):
    """Each row is found, wherever its text is from: batches with it and without it, compacted too, and after stages that change it."""
    path = str(tmp_path / "logs")
    K.write_logs(batch(make_logs, "needle", [f"a{k}" for k in range(30)]), path, "1", text=True)
    K.write_logs(batch(make_logs, "needle", [f"b{k}" for k in range(30)]), path, "2")
    found = lambda: P.search(K.read_logs(spark, path), terms=["needle"]).count()
    assert found() == 60
    K.compact(spark, path)
    assert found() == 60
    K.write_logs(batch(make_logs, "needle", [f"c{k}" for k in range(30)]), path, "3")
    assert found() == 90
    stage = E.Stage("set", to="word", value="haystack")
    changed = E.apply_pipelines(K.read_logs(spark, path), [E.Pipeline("p", (stage,))])
    assert "text_norm" not in changed.columns and P.search(changed, terms=["haystack"]).count() == 90


def test_one_rule_for_tokens(spark, make_logs):
    df = make_logs([("a", 0, "s", "h", "info", "area 5 m² ½ x_y Ⅷ ٣٤", "{}"), ("b", 1, "s", "h", "info", "5 m", "{}")])
    for term, want in (("m²", "ab"), ("½", ""), ("x_y", "a"), ("٣", "a"), ("Ⅷ", ""), ("5 m", "ab")):
        assert "".join(sorted(r.id for r in P.search(df, terms=[term]).collect())) == want, term


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString().replace("`", "")


def scanned(df):
    """Rows that came out of the scan of files, row groups that were skipped left out."""
    df.collect()
    plan, found = df._jdf.queryExecution().executedPlan(), []

    def walk(node):
        if node.nodeName().startswith("Scan parquet"):
            found.append(node.metrics().apply("numOutputRows").value())
        for method in ("children", "innerChildren"):
            kids = getattr(node, method)()
            for k in range(kids.size()):
                walk(kids.apply(k))
        if node.nodeName() == "AdaptiveSparkPlan":
            walk(node.executedPlan())
        if "QueryStage" in node.nodeName():
            walk(node.plan())

    walk(plan)
    return sum(found)


def test_filters_reach_files(spark, make_logs, tmp_path):
    """Conditions on columns, and on attributes with columns of their own, are pushed down, and row groups are skipped by them."""
    path = str(tmp_path / "logs")
    df = make_logs([(f"{k:05}", k, f"svc{k // 1000}", "h", "error" if k % 7 == 0 else "info", f"m {k}", json.dumps({"status": 200 + k // 500, "user": f"u{k}", **({"rare": "x"} if k % 50 == 0 else {})})) for k in range(4000)])
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "500")
    try:
        K.write_logs(df, path, "1", typed=2)
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    stored = K._read_batches(spark, path, ["1"])
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    assert {c for c in stored.columns if c.startswith("attr:")} == {"attr:status", "attr:status#", "attr:user", "attr:user#"}
    pushed = {
        ("level", "=", "error"): "EqualTo(level,error)", ("service", "in", ("svc1", "svc2")): "In(service, [svc1,svc2])", ("message", "exists", None): "Not(EqualTo(message,",
        ("level", "!=", "info"): "Not(EqualTo(level,info))", ("source", ">", "a"): "GreaterThan(source,a)",
        ("attr.status", "=", "203"): "EqualTo(attr:status,203)", ("attr.status", ">=", 206): "GreaterThanOrEqual(attr:status#,206.0)", ("user", "in", ("u7", "u9")): "In(attr:user, [u7,u9])",
    }
    for f, text in pushed.items():
        assert text in plan_of(P.search(stored, [f])), (f, plan_of(P.search(stored, [f])))
    for f in [*pushed, ("attr.status", "!=", "203"), ("attr.status", "exists", None), ("attr.rare", "exists", None), ("attr.rare", "!=", "x"), ("attr.rare", "=", "x"), ("attr.user", "like", "u1*"), ("attr.status", "regex", "^20[13]$"), ("attr.none", "=", "1"), ("user", "=", "true"), ("status", "<", "zzz")]:
        want = sorted(r.id for r in P.search(df, [f]).collect())
        assert sorted(r.id for r in P.search(stored, [f]).collect()) == want, f
        assert sorted(r.id for r in df.where(P.pred(*f)).collect()) == want and sorted(r.id for r in df.where(~P.pred(*f)).collect()) == sorted({f"{k:05}" for k in range(4000)} - set(want))
    assert scanned(P.search(stored, [("attr.status", "=", "203")])) <= 1000
    assert scanned(P.search(stored, [("attr.user", "=", "u1234")])) <= 1000
    assert scanned(P.search(stored, [("attr.status", ">=", 206)])) <= 2000
    assert scanned(P.search(stored, [("service", "=", "svc3")])) <= 1500
    K.write_logs(df.limit(300).withColumn("id", F.concat(F.lit("plain"), "id")), path, "2")  # rows of a batch without the columns
    K.compact(spark, path)
    both = K.read_logs(spark, path)
    assert P.search(both, [("attr.status", "=", "200")]).count() == 800 and P.search(both, [("attr.user", "in", ["u5"])]).count() == 2


def test_a_batch_is_sorted_once(spark, make_logs, tmp_path):
    """One sort, by day, service and time, of which the writer needs no other; files are in order."""
    path = str(tmp_path / "logs")
    logs = batch(make_logs, "x", [f"a{k}" for k in range(40)]).withColumns({"service": F.concat(F.lit("s"), (F.xxhash64("id") % 3).cast("string")), "ts": F.col("ts") + F.expr("make_dt_interval(0, pmod(xxhash64(id), 72))")})
    K.write_logs(logs.coalesce(1), path, "1")
    done = spark._jsparkSession.sharedState().statusStore().executionsList()
    plan = next(p for k in range(done.size() - 1, -1, -1) if "InsertIntoHadoopFsRelationCommand" in (p := done.apply(k).physicalPlanDescription()) and f"{path}/ingest_batch=1" in p)
    assert len(re.findall(r"^\(\d+\) Sort", plan, re.M)) == 1
    for day in {r.dt for r in K.read_logs(spark, path).select("dt").collect()}:
        held = [(r.service, r.ts) for r in spark.read.parquet(f"{path}/ingest_batch=1/dt={day}").collect()]
        assert held == sorted(held)


@pytest.mark.parametrize("few", [3, 1000])
def test_ids_of_large_batches_stay_apart(spark, make_logs, tmp_path, monkeypatch, few):
    """Ids of batches are sent to all tasks only if they are few, and rows are the same either way."""
    monkeypatch.setattr(K, "FEW_IDS", few)
    path = str(tmp_path / "logs")
    K.write_logs(batch(make_logs, "old", [f"a{k}" for k in range(20)]), path, "1")
    K.compact(spark, path)
    K.write_logs(batch(make_logs, "new", [f"a{k}" for k in range(5, 15)], seconds=9), path, "2")
    plan = K.read_logs(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert ("SortMergeJoin" in plan, "BroadcastHashJoin" in plan) == ((True, False) if few == 3 else (False, True))
    want = sorted((f"a{k}", f"{'new' if 5 <= k < 15 else 'old'} a{k}") for k in range(20))
    assert sorted(rows(spark, path)) == want
    K.compact(spark, path)
    assert sorted(rows(spark, path)) == want
