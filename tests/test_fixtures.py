"""Small cases with exact results."""

from __future__ import annotations

import json
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from emberlog.functions import grok as G
from emberlog.functions import predicates as P
from emberlog.functions import scalars as S
from emberlog.functions import text as X
from emberlog.operators import admission as AD
from emberlog.operators import aggregate as A
from emberlog.operators import alerts as R
from emberlog.operators import paging as L
from emberlog.operators import pipelines as E
from emberlog.operators import sinks as K
from emberlog.sources import otlp, readers, syslog
from emberlog.streaming import streams as W

from .conftest import BASE

SEED = [
    ("a", 1, "checkout-api", "node-1", "error", "upstream request timeout calling payments", '{"user_id":42,"status":504}'),
    ("b", 2, "checkout-api", "node-1", "warn", "slow upstream payments", '{"user_id":7}'),
    ("c", 3, "auth-svc", "node-2", "info", "issued access token", '{"user_id":42}'),
    ("d", 4, "auth-svc", "node-2", "error", "rate limit exceeded", "{}"),
    ("e", 5, "worker", "node-3", "debug", "flushed events to index", "{}"),
]


def ids(df):
    return "".join(sorted(r.id for r in df.select("id").collect()))


@pytest.mark.parametrize(
    ("filters", "terms", "want"),
    [
        ([("level", "=", "error")], [], "ad"), ([], ["timeout"], "a"), ([("service", "=", "checkout-api")], ["payments"], "ab"),
        ([("attr.user_id", "=", "42")], [], "ac"), ([("attr.status", "=", "504")], [], "a"), ([("attr.user_id", "!=", "42")], [], "bde"),
        ([("attr.status", ">=", "504")], [], "a"), ([("attr.status", ">", "504")], [], ""), ([("attr.status", "<", "600")], [], "a"),
        ([("service", "like", "checkout*")], [], "ab"), ([("service", "like", "AUTH*")], [], "cd"), ([("attr.status", "exists", None)], [], "a"),
        ([("level", "in", ["ERROR", "WARN"])], [], "abd"), ([("message", "regex", "payments")], [], "ab"), ([("message", "regex", "^issued")], [], "c"),
        ([("message", "like", "*timeout*")], [], "a"), ([("level", "in", [])], [], ""), ([], ["  "], ""),
    ],
)
def test_search(make_logs, filters, terms, want):
    assert ids(P.search(make_logs(SEED), filters, terms)) == want


def test_range_and_pages(make_logs):
    df = make_logs(SEED)
    found = P.search(df, start=BASE + timedelta(minutes=2), end=BASE + timedelta(minutes=4))
    assert [r.id for r in L.page(found, 2, "oldest").collect()] == ["b", "c"] and found.count() == 3
    seen, after = [], None
    while rows := L.page(df, 2, "newest", after).collect():
        seen += [r.id for r in rows]
        after = (rows[-1].ts.replace(tzinfo=UTC), rows[-1].id)
    assert seen == list("edcba")
    kept, removed = K.retain(df, 1, BASE + timedelta(days=1, minutes=3))
    assert ids(kept) == "cde" and removed.first().removed == 2
    with pytest.raises(ValueError):
        L.page(df, 5001)


def test_booleans_and_coercion(make_logs):
    df = make_logs([(str(k), k, "s", "h", "info", "m", a) for k, a in enumerate(['{"flag":true}', '{"flag":false}', '{"flag":"true"}', "{}"], 1)])
    for op, value, want in (("=", "true", "13"), ("=", "false", "2"), ("!=", "true", "24"), ("!=", "false", "134"), ("=", "1", "1"), ("=", "0", "2"), ("exists", None, "123")):
        assert ids(P.search(df, [("attr.flag", op, value)])) == want, (op, value)
    df = make_logs([("a", 1, "S", "h", "info", "m", '{"status":504}'), ("b", 2, "S", "h", "info", "m", '{"status":"not-a-number"}'), ("c", 3, "S", "h", "info", "m", '{"status":200}'), ("d", 4, "S", "h", "info", "m", '{"status":null}')])
    assert ids(P.search(df, [("attr.status", "<", "300")])) == "bc"
    assert ids(P.search(df, [("attr.status", "!=", "200")])) == "abd"


def test_terms(make_logs):
    rows = [
        ("1", 1, "checkout-api", "host-1", "info", "connection refused by upstream", "{}"), ("2", 2, "billing", "host-2", "info", "error while handling request", "{}"),
        ("3", 3, "checkout-api", "host-3", "info", "request completed", '{"status":500,"region":"eu-west"}'), ("4", 4, "billing", "host-1", "info", "timeout contacting payments", "{}"),
        ("5", 5, "legacy", "host-9", "info", "raw unstructured erroneous text", "{}"),
    ]
    df = make_logs(rows)
    for term, want in {"connection": "1", "conn": "1", "connection refused": "1", "connection refu": "1", "refused connection": "", "conn refused": "", "err": "25", "error": "2", "500": "3", "eu": "3", "nnection": "", "request": "23", "hos": "12345", "check": "13"}.items():
        assert ids(P.search(df, terms=[term])) == want, term
    index = X.build_index(df)
    assert ids(X.search_index(index, ["req", "status"])) == "3" and ids(X.search_index(index, [" "])) == ""


def test_stats(make_logs):
    rows = [("1", 0, "api", "h", "error", "m", '{"latency_ms":100}'), ("2", 0, "api", "h", "error", "m", '{"latency_ms":300}'), ("3", 1, "api", "h", "info", "m", '{"latency_ms":50}'), ("4", 1, "web", "h", "error", "m", '{"latency_ms":200}'), ("5", 2, "web", "h", "info", "m", '{"latency_ms":10}'), ("6", 2, "db", "h", "info", "m", '{"latency_ms":20}')]
    df = make_logs(rows)
    assert [tuple(r) for r in A.stats(df, [("count",)], ["service"]).collect()] == [("api", 3), ("web", 2), ("db", 1)]
    api = A.stats(df.where("service = 'api'"), [("count",), *((f, "attr.latency_ms") for f in ("sum", "avg", "min", "max"))]).first()
    assert tuple(api) == (3, 450, 150, 50, 300)
    assert A.stats(df, [("dc", "service")]).first()[0] == 3
    assert [r["count"] for r in A.timechart(df, [("count",)]).collect()] == [2, 2, 2]
    assert A.top(df, ["service"], 2).first().service == "api" and A.rare(df, ["service"], 1).first().service == "db"
    assert [tuple(r) for r in A.stats(df, [("count",)], ["attr.none"]).collect()] == [("", 6)]
    assert A.stats(P.search(df, terms=["zzzz"]), [("count",)]).first()[0] == 0
    assert A.bucket_for("24h") == "30m" and A.bucket_for("?") == "1h"
    cut = A.capped(A.stats(df, [("count",)], ["service"]), 2).collect()
    assert len(cut) == 2 and all(r.truncated for r in cut)


def test_helpers():
    assert S.duration("15m") == timedelta(minutes=15) and S.duration("0s") == timedelta(0)
    for bad in ("15", "m", "-1m", "999999d"):
        with pytest.raises(ValueError):
            S.duration(bad)
    assert S.absolute("1750000000").year == 2025
    assert S.decode_cursor(S.encode_cursor(BASE, "x|y")) == (BASE, "x|y")
    assert S.like_pattern("a*b%_") == "a%b\\%\\_"
    now = datetime(2026, 1, 2, tzinfo=UTC)
    assert P.resolve_bounds((now, None), (BASE, BASE), now) == (now, BASE)
    assert P.resolve_bounds((None, None), (None, None), now, timedelta(hours=1)) == (now - timedelta(hours=1), None)
    with pytest.raises(ValueError):
        P.pred("message", "regex", "(?P<x>a)")


NOW = datetime(2026, 6, 14, 12, tzinfo=UTC)


def test_ndjson(spark, tmp_path):
    lines = [
        '{"msg":"boom","severity":"ERROR","host":"node-1","logger":"checkout-api","time":"2026-06-14T11:59:00Z","user_id":42,"nested":{"k":"v"}}',
        '{"message":"hi","timestamp":1750000000000,"attributes":{"a":1,"user_id":1}}', '{"message":"bye"}', "not json", '{"timestamp":"yesterday"}',
        '{"timestamp":"2026-06-16T12:00:01Z"}', '{"message":"ok","timestamp":"2026-06-15T12:00:00Z"}', "", "[1]", '{"message":"' + "x" * 3000 + '"}',
    ]
    (tmp_path / "a.ndjson").write_text("\n".join(lines))
    logs, rejects = readers.read_ndjson(spark, str(tmp_path), now=NOW, max_bytes=2000)
    got = {r.message: r for r in logs.withColumn("j", F.to_json("attributes")).collect()}
    assert set(got) == {"boom", "hi", "bye", "ok"}
    assert (got["boom"].level, got["boom"].source, got["boom"].service) == ("error", "node-1", "checkout-api")
    assert got["boom"].j == '{"nested":{"k":"v"},"user_id":42}' or '"user_id":42' in got["boom"].j
    assert got["hi"].level == "info" and got["hi"].ts.year == 2025 and got["bye"].ts == NOW.replace(tzinfo=None)
    assert all(len(r.id) == 26 for r in got.values()) and len({r.id for r in got.values()}) == 4
    reasons = sorted(r.reason for r in rejects.collect())
    assert len(reasons) == 5 and sum("longer" in r for r in reasons) == 1 and sum("future" in r for r in reasons) == 1
    again, _ = readers.read_ndjson(spark, str(tmp_path), now=NOW, max_bytes=2000)
    assert sorted(r.id for r in again.collect()) == sorted(r.id for r in got.values())


def test_other_sources(spark, tmp_path):
    (tmp_path / "arr").mkdir()
    (tmp_path / "arr/a.json").write_text('[{"msg":"one"},{"msg":"two"}, 3]')
    logs, rejects = readers.read_json_array(spark, str(tmp_path / "arr"), now=NOW)
    assert sorted(r.message for r in logs.collect()) == ["one", "two"] and rejects.count() == 1
    (tmp_path / "multi").mkdir()
    (tmp_path / "multi/a.json").write_text('{\n "msg": "one"\n}\n{"msg":\n"two"}\n{broken\n{"msg":"three"}')
    logs, rejects = readers.read_json_multiline(spark, str(tmp_path / "multi"), now=NOW)
    assert sorted(r.message for r in logs.collect()) == ["one", "three", "two"] and rejects.count() == 1
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw/a.log").write_text("first\r\n\n  \nsecond")
    raw = readers.read_raw(spark, str(tmp_path / "raw"), "svc", "host", now=NOW)
    assert sorted(r.message for r in raw.collect()) == ["first", "second"]
    assert readers.merge_logs(raw, logs).count() == 5


def attrs(row):
    return {k: None if v is None else v.toPython() for k, v in row.attributes.items()}


def test_syslog(spark):
    lines = [
        '<34>1 2003-10-11T22:14:15.003Z mymachine.example.com su - ID47 [exampleSDID@32473 iut="3" eventSource="Apple"] \'su root\' failed for lonvick',
        r'<14>1 2026-07-26T10:00:00Z host app 42 - [a x="brack]et" y="quo\"te"][b@1 z="1"] the message',
        "<34>Oct 11 22:14:15 mymachine su[1234]: 'su root' failed for lonvick", "<14>Dec 31 23:59:00 host app: end of year", "no priority at all\r\n",
    ]
    now = datetime(2026, 1, 2, tzinfo=UTC)
    rows = {r.raw: r for r in syslog.parse_syslog(spark.createDataFrame([(x,) for x in lines], "value string"), now=now).collect()}
    a, b, c, d, e = (rows[x.rstrip("\r\n")] for x in lines)
    assert (a.level, a.service, a.source, a.message) == ("fatal", "su", "mymachine.example.com", "'su root' failed for lonvick")
    assert attrs(a) == {"facility": "auth", "severity": "crit", "msgid": "ID47", "exampleSDID@32473.iut": "3", "exampleSDID@32473.eventSource": "Apple"}
    assert attrs(b) | {"facility": 0, "severity": 0} == {"facility": 0, "severity": 0, "procid": "42", "a.x": "brack]et", "a.y": 'quo"te', "b@1.z": "1"} and b.message == "the message"
    assert (c.service, attrs(c)["procid"], c.message) == ("su", "1234", "'su root' failed for lonvick") and c.ts.year == 2025
    assert d.ts == datetime(2025, 12, 31, 23, 59) and d.service == "app"
    assert e.message == "no priority at all" and e.ts == now.replace(tzinfo=None)


def test_otlp(spark):
    body = """{"resourceLogs":[{"resource":{"attributes":[{"key":"service.name","value":{"stringValue":"billing"}},{"key":"host.name","value":{"stringValue":"node-2"}}]},
      "scopeLogs":[{"scope":{"name":"scope"},"logRecords":[{"timeUnixNano":"1785000000000000000","severityNumber":13,"severityText":"Warn","body":{"stringValue":"disk almost full"},
      "attributes":[{"key":"pct","value":{"doubleValue":91.5}},{"key":"ok","value":{"boolValue":false}},{"key":"tags","value":{"arrayValue":{"values":[{"stringValue":"a"},{"stringValue":"b"}]}}}],"traceId":"abc123"}]}]}]}"""
    r = otlp.parse_otlp_json(spark.createDataFrame([(body,), ("junk",)], "value string"), now=NOW).collect()
    assert len(r) == 1
    r = r[0]
    assert (r.service, r.source, r.level, r.message) == ("billing", "node-2", "warn", "disk almost full") and r.ts == datetime.fromtimestamp(1785000000, UTC).replace(tzinfo=None)
    found = attrs(r)
    assert found["pct"] == 91.5 and found["ok"] is False and found["tags"] == ["a", "b"] and found["trace_id"] == "abc123" and found["service.name"] == "billing"


def test_pipelines(make_logs):
    def run(message, *pipelines, attributes="{}"):
        df = make_logs([("x", 0, "", "h", "info", message, attributes)])
        return E.dry_run(df, pipelines).first()

    line = '192.168.1.10 - - [26/Jul/2026:12:00:01 +0000] "GET /v1/checkout?x=1 HTTP/1.1" 500 1234'
    r = run(line, E.Pipeline("p", (E.Stage("grok", pattern=r'%{IPORHOST:client} - - \[%{HTTPDATE:ts}\] "%{HTTPVERB:method} %{NOTSPACE:path} %{HTTPVER}" %{INT:status} %{INT:bytes}'),)))
    assert attrs(r) == {"client": "192.168.1.10", "ts": "26/Jul/2026:12:00:01 +0000", "method": "GET", "path": "/v1/checkout?x=1", "status": 500.0, "bytes": 1234.0}
    r = run("ERROR checkout-api connection refused", E.Pipeline("p", (E.Stage("grok", pattern="%{LOGLEVEL:level} %{LOGGER:service} %{GREEDYDATA:message}"),)))
    assert (r.level, r.service, r.message, attrs(r)) == ("error", "checkout-api", "connection refused", {})
    for text in ("2026-07-26T10:30:00Z", "26/Jul/2026:10:30:00 +0000", "1785061800"):
        r = run("m", E.Pipeline("p", (E.Stage("timestamp", "attr.t"),)), attributes=f'{{"t":"{text}"}}')
        assert r.ts == datetime(2026, 7, 26, 10, 30), text
    r = run("m", E.Pipeline("p", (E.Stage("timestamp", "attr.t", layouts=("dd-MM-yyyy HH:mm",)),)), attributes='{"t":"26-07-2026 10:30"}')
    assert r.ts == datetime(2026, 7, 26, 10, 30)
    ip, mark = "%{IPV4:ip}", E.Stage("set", to="marker", value="yes")
    r = run("this line has no IP in it", E.Pipeline("p", (E.Stage("grok", pattern=ip), mark)))
    assert attrs(r) == {"marker": "yes"} and r.matched == ["p"] and len(r.errors) == 1
    assert attrs(run("no ip here", E.Pipeline("p", (E.Stage("grok", pattern=ip, fail_pipeline=True), mark)))) == {}
    assert attrs(run("404 GET", E.Pipeline("p", (E.Stage("grok", pattern="%{INT:http.status} %{WORD:http.method}"),)))) == {"http.status": 404.0, "http.method": "GET"}
    r = run("m", E.Pipeline("p", (E.Stage("rename", "attr.old", to="new"), E.Stage("remove", fields=("attr.junk", "attr.none")), E.Stage("set", to="env", value="prod"))), attributes='{"old":"v","junk":1}')
    assert attrs(r) == {"new": "v", "env": "prod"}
    two = [E.Pipeline(str(k), (E.Stage("set", to="w", value=str(k)),), order=k) for k in (2, 1)]
    assert attrs(run("m", *two)) == {"w": 2.0}
    assert attrs(run("m", E.Pipeline("p", tuple(E.Stage("set", to=k, value=v) for k, v in (("a", "007"), ("b", "1e5"), ("c", "-2.5")))))) == {"a": "007", "b": "1e5", "c": -2.5}
    for bad in (E.Pipeline("p", ()), E.Pipeline("p", (E.Stage("grok", pattern="%{NOPE:x}"),)), E.Pipeline("p", (E.Stage("rename", "a"),)), E.Pipeline("p", (E.Stage("remove"),)), E.Pipeline("p", (E.Stage("regex", pattern="(?P<a>("),))):
        with pytest.raises(ValueError):
            E.validate([bad])
    assert G.numbered("(a)(?P<n>b)[(](?:c)(?<m>d)")[1] == {"n": 2, "m": 3}


def test_alerts(spark, make_logs):
    logs = make_logs([(f"a{k}", 0, "api", "h", "error", "m", "{}") for k in range(50)] + [(f"w{k}", 0, "web", "h", "error", "m", "{}") for k in range(12)] + [(f"d{k}", 0, "db", "h", "error", "m", "{}") for k in range(3)])
    rule = R.Rule("r", "R", "gt", 10, by=("service",))
    r = R.evaluate(logs, rule, BASE).first()
    assert (r.value, r.firing, [(g.label, g.value) for g in r.groups]) == (50, True, [("service=api", 50), ("service=web", 12)])
    quiet = R.Rule("q", "Q", "gt", 100, by=("service",))
    assert tuple(R.evaluate(logs, quiet, BASE).first())[2:4] == (50, False)
    dead = R.Rule("d", "D", "lt", 1, (("service", "=", "none"),))
    assert tuple(R.evaluate(logs, dead, BASE).first())[2:4] == (0, True)
    rows = [("r", BASE + timedelta(minutes=k), float(v), v > 10, None if k < 6 else "broken") for k, v in enumerate([1, 99, 99, 99, 99, 0, 99])]
    evals = spark.createDataFrame(rows, "rule_id string, at timestamp, value double, firing boolean, error string").withColumn("groups", F.array().cast("array<struct<label:string,value:double>>"))
    turned = R.transitions(evals)
    assert [r.state for r in turned.where("notify").orderBy("at").collect()] == ["firing", "ok"]
    assert turned.orderBy(F.desc("at")).first().state == "unknown"
    channels = spark.createDataFrame([("a", "slack", "u")], "id string, type string, url string")
    rule = R.Rule("r", "Errors", "gt", 10, channels=("a", "gone"), query="level=error")
    sent = R.notifications(turned, [rule], channels).orderBy("at", "channel").collect()
    assert len(sent) == 4 and [s.missing for s in sent] == [False, True, False, True]
    assert sent[0].text == "🔴 FIRING: Errors — 99 > 10 over 300s\nquery: level=error" and len({s.dedup_key for s in sent}) == 1
    for bad in ({"interval_s": 5}, {"window_s": 5}, {"window_s": 10, "interval_s": 60}, {"op": "x"}):
        with pytest.raises(ValueError):
            R.Rule(**({"id": "r", "name": "R", "op": "gt", "value": 1} | bad)).validate()


def test_admission(spark):
    rows = [("k", BASE + timedelta(seconds=t), 1, 100) for t in (0, 0.5, 1, 5, 86400)]
    df = spark.createDataFrame(rows, "key string, ts timestamp, events long, bytes long")
    assert [r.allowed for r in AD.token_bucket(df, 1).orderBy("ts").collect()] == [True, False, True, True, True]
    assert [r.refused for r in AD.quota_flags(df, max_bytes=250, max_events=10).orderBy("ts").collect()] == [None, None, "bytes", "bytes", None]
    rows = [("b", BASE + timedelta(minutes=m)) for m in (0, 9, 11, 20)] + [(None, BASE), (None, BASE)]
    got = AD.retried(spark.createDataFrame(rows, "batch_id string, ts timestamp")).where("batch_id is not null").orderBy("ts").collect()
    assert [r.duplicate for r in got] == [False, True, False, True]


def test_streams(spark, make_logs, tmp_path):
    df = make_logs(SEED)
    df.write.parquet(str(tmp_path / "in"))
    got = []
    W.backfill_then_tail(df.where("id < 'c'"), W.read_logs_stream(spark, str(tmp_path / "in")), lambda b, k: got.extend((k, r.id) for r in b.collect()), str(tmp_path / "ck")).awaitTermination()
    assert [i for k, i in got if k == -1] == ["a", "b"] and sorted(i for _, i in got) == list("abcde")
    requests = spark.createDataFrame([("b1", 1, BASE), ("b1", 1, BASE), ("b1", 2, BASE), (None, 1, BASE), (None, 1, BASE)], "batch_id string, line_no int, received_at timestamp")
    requests.write.parquet(str(tmp_path / "req"))
    stream = spark.readStream.schema(requests.schema).parquet(str(tmp_path / "req"))
    W.run_to_table(W.dedupe_batches(stream), "deduped")
    assert spark.table("deduped").count() == 4
    evals = spark.createDataFrame([("r", BASE + timedelta(minutes=k), f, None) for k, f in enumerate([False, True, True, False])], "rule_id string, at timestamp, firing boolean, error string")
    evals.write.parquet(str(tmp_path / "ev"))
    W.run_to_table(W.alert_state_stream(spark.readStream.schema(evals.schema).parquet(str(tmp_path / "ev"))), "states")
    assert [r.state for r in spark.table("states").where("notify").orderBy("at").collect()] == ["firing", "ok"]


def test_sinks(spark, make_logs, tmp_path):
    df = make_logs(SEED)
    K.write_logs(df, str(tmp_path / "logs"), "1")
    K.write_logs(df, str(tmp_path / "logs"), "1")
    assert K.read_logs(spark, str(tmp_path / "logs")).count() == 5
    assert K.purge(spark, str(tmp_path / "logs"), 1, BASE + timedelta(days=1, minutes=3)) == 2
    assert ids(K.read_logs(spark, str(tmp_path / "logs"))) == "cde"
    whole = K.export_json(df).first().value
    assert whole.startswith('[{"id":"e"') and whole.endswith("]")
    K.write_rejects(df.select("id").withColumn("reason", F.lit("x")), str(tmp_path / "rejects"), "1", NOW)
    assert spark.read.json(str(tmp_path / "rejects")).count() == 5


def test_export_json_array(spark, make_logs, tmp_path):
    """All rows in one array over several files, in order, however many there are."""
    df = make_logs([(f"{k:04}", k // 3, "s", "a", "error", 'x,"\n]' if k % 2 else "m", None) for k in range(1200)])
    for order, rows in (("newest", df.repartition(3)), ("oldest", df), ("newest", df.limit(0))):
        K.export_json_array(rows, str(tmp_path / "array"), order)
        text = "".join(p.read_text() for p in sorted((tmp_path / "array").glob("part-*")))
        assert [r["id"] for r in json.loads(text)] == [r.id for r in K.ordered(rows, order).collect()]
        assert K.read_json_array_lines(spark, str(tmp_path / "array"), "id string, message string").count() == rows.count()


def test_k3_exports_all(spark, monkeypatch):
    """The query and its array have all errors."""
    from emberlog.plans.registry import QUERIES

    paths, export = [], K.export_json_array
    monkeypatch.setattr(K, "export_json_array", lambda df, path, *a: (paths.append(path), export(df, path, *a)))
    errors = spark.read.parquet("/root/testdata/sf0.01/events.parquet").where("event_type = 'error'").count()
    assert QUERIES["k3_export_json"](spark, "/root/testdata/sf0.01").count() == errors
    assert errors > 500 and spark.read.text(paths[0]).where("value <> ']'").count() == errors


def test_stream_in_many_batches(spark, tmp_path):
    """A file per batch loses no row to the watermark: closed buckets are those of the batch chart."""
    from emberlog.schema import LOGS, events

    logs = events(spark, "/root/testdata/sf0.001").select(*LOGS.fieldNames())
    W.write_in_order(logs.repartition(5), str(tmp_path / "in"), 12)
    chart = W.stream_timechart(W.read_logs_stream(spark, str(tmp_path / "in"), per_batch=1), [("count",)], "1 hour")
    query = chart.writeStream.option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).format("parquet").start(str(tmp_path / "out"))
    query.awaitTermination()
    got = {r.bucket: r["count"] for r in spark.read.schema(chart.schema).parquet(str(tmp_path / "out")).collect()}
    last = logs.agg(F.max("ts")).first()[0] - timedelta(minutes=10)
    want = {r.b: r.n for r in logs.groupBy(F.date_trunc("hour", "ts").alias("b")).agg(F.count("*").alias("n")).collect() if r.b + timedelta(hours=1) <= last}
    assert len(want) > 100 and got == want


def test_plans(spark):
    """Filters reach the scan and only needed columns are read."""
    from emberlog.schema import events

    plan = events(spark, "/root/testdata/sf0.001").where("service = 'error'").select("id")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,error)]" in plan and "ReadSchema: struct<event_id:bigint,event_type:string>" in plan


@pytest.mark.parametrize(("window", "interval", "measure"), [(600, 60, ("count",)), (610, 60, ("sum", "attr.n")), (3600, 10, ("max", "attr.n")), (60, 60, ("dc", "source")), (7200, 7200, ("avg", "attr.n")), (90, 60, ("min", "attr.n")), (10_000, 50, ("dc", "attr.n"))])
def test_rule_panes(make_logs, window, interval, measure):
    """Windows put together from panes hold just the events from at - window to at, both included, by group."""
    import random

    r = random.Random(window + interval)
    rows = [(f"{k:04}", m, f"s{r.randrange(3)}", f"h{r.randrange(6)}", "info", "m", json.dumps({"n": r.randrange(50)} if r.random() < 0.9 else {})) for k in range(300) for m in [r.choice([r.randrange(-200, 200), r.randrange(-20_000, 20_000) / 100])]]
    df, start, n = make_logs(rows), BASE + timedelta(minutes=7), 40
    rule = R.Rule("r", "r", "gte", 20, by=("service",), measure=measure, window_s=window, interval_s=interval)
    got = {x.at: {g.label: g.value for g in x.groups} for x in R.backtest_rule(df, R.Rule(**{**rule.__dict__, "value": -1.0}), start, start + timedelta(seconds=interval * (n - 1))).collect()}
    value = {"sum": sum, "max": max, "min": min, "avg": lambda v: sum(v) / len(v), "dc": lambda v: len(set(v))}
    assert len(got) == n
    for k in range(n):
        at = start + timedelta(seconds=interval * k)
        held = {}
        for _, m, service, source, _, _, a in rows:
            if at - timedelta(seconds=window) <= BASE + timedelta(minutes=m) <= at:
                x = source if measure[-1] == "source" else json.loads(a).get("n")
                held.setdefault(f"service={service}", []).append(x)
        want = {}
        for g, v in held.items():
            some = [x for x in v if x is not None]
            if measure[0] == "count":
                want[g] = len(v)
            elif some or measure[0] == "dc" and False:
                want[g] = value[measure[0]](some)
        assert {g: v for g, v in got[at.replace(tzinfo=None)].items()} == pytest.approx(want)


def test_long_rule(spark, make_logs):
    """A window of 30 days every ten seconds neither copies events nor windows without bound."""
    df = make_logs([(f"{k}", 60 * k, "s", "h", "info", "m", "{}") for k in range(48)])
    rule = R.Rule("long", "long", "gt", 0, window_s=30 * 86400, interval_s=10)
    rows = R.backtest_rule(df, rule, BASE, BASE + timedelta(hours=6)).orderBy("at").collect()
    assert len(rows) == 2161 and [rows[k].value for k in (0, 359, 360, 2160)] == [1.0, 1.0, 2.0, 7.0]


def test_ids_follow_places(spark, tmp_path):
    """Lines have the ids of their places however files are split, and equal lines stay two, from every source."""
    now = datetime(2026, 1, 1, tzinfo=UTC)
    for k in range(3):
        (tmp_path / f"f{k}.log").write_text("".join(f'{{"msg":"line {n % 700}"}}\n' + "\n" * (n % 5 == 0) for n in range(4000 + k)))
    (tmp_path / "s.log").write_text("<14>1 2026-01-01T00:00:00Z h a - - - same\n" * 3)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    found, syslogs = [], []
    try:
        for size in ("128m", "10k", "4k"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            logs = readers.read_ndjson(spark, f"{tmp_path}/f*.log", now=now)[0]
            found.append({r.id: r.message for r in logs.select("id", "message").collect()})
            assert readers.read_raw(spark, f"{tmp_path}/f*.log", "s", "s", now=now).agg(F.count_distinct("id")).first()[0] == 12_003
            syslogs.append(sorted(r.id for r in syslog.read_syslog(spark, f"{tmp_path}/s.log", now=now).collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(found[0]) == 12_003 and found[0] == found[1] == found[2]
    assert len(set(syslogs[0])) == 3 and syslogs[0] == syslogs[1]
    body = '{"resourceLogs":[{"scopeLogs":[{"logRecords":[{"body":{"stringValue":"x"}}]}]}]}'
    assert otlp.parse_otlp_json(spark.createDataFrame([(body,)] * 2, "value string"), now=now).select("id").distinct().count() == 2


def test_stored_batches(spark, make_logs, tmp_path):
    """The tenth batch beats the ninth; compaction changes no row; a filter reaches compacted files; a purge that was lost goes on."""
    path = str(tmp_path / "logs")
    for batch in ("9", "10"):
        K.write_logs(make_logs([("a", 0, "s", "h", "info", f"batch {batch}", "{}"), (f"only {batch}", 60 * 24, "s", "h", "info", "x", "{}")]), path, batch, text=True)
    rows = lambda: sorted((r.id, r.message) for r in K.read_logs(spark, path).collect())
    want = [("a", "batch 10"), ("only 10", "x"), ("only 9", "x")]
    assert rows() == want
    K.compact(spark, path)
    assert rows() == want
    K.compact(spark, path)
    K.write_logs(make_logs([("a", 0, "s", "h", "info", "batch 11", "{}"), ("new", 5, "s", "h", "info", "y", "{}")]), path, "11", text=True)
    want = [("a", "batch 11"), ("new", "y"), *want[1:]]
    assert rows() == want
    plan = K.read_logs(spark, path).where(F.col("ts") > F.lit(BASE + timedelta(hours=5)))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(ts), GreaterThan(ts," in plan
    assert [r.id for r in P.search(K.read_logs(spark, path), terms=["batch 1"]).collect()] == ["a"]
    K.compact(spark, path)
    assert rows() == want
    K.write_logs(make_logs([("late", 30, "s", "h", "info", "z", "{}")]), path, "12", text=True)
    day = f"{path}/ingest_batch=12/dt={BASE.date()}"
    import os

    os.rename(day, f"{path}/ingest_batch=12/.old-{BASE.date()}")  # as a run leaves it that was lost in between
    assert K.purge(spark, path, 1, BASE + timedelta(days=1, minutes=10)) == 2
    assert rows() == [("late", "z"), *want[2:]]


def test_small_and_large_arrays(spark, make_logs, tmp_path):
    df = make_logs([(f"{k}", k, "s", "h", "info", "m", "{}") for k in range(5)])
    assert [x["id"] for x in json.loads(K.export_json(df).first().value)] == ["4", "3", "2", "1", "0"]
    with pytest.raises(Exception, match="more than 3 rows"):
        K.export_json(df, most=3).collect()
    for _ in range(2):
        K.write_rejects(df.select("id"), str(tmp_path / "r"), "b", BASE)
    assert spark.read.json(str(tmp_path / "r")).count() == 5


def test_retries(spark):
    """Strictly less than ten minutes after the first sighting; null and empty ids never."""
    at = [("a", 0), ("a", 599), ("a", 600), ("a", 1199), ("a", 1200), ("", 0), ("", 1), (None, 0), (None, 1)]
    df = spark.createDataFrame([(b, BASE + timedelta(seconds=t)) for b, t in at], "batch_id string, ts timestamp")
    got = {(r.batch_id, r.ts.minute * 60 + r.ts.second): r.duplicate for r in AD.retried(df).collect()}
    assert [got[x] for x in at] == [False, True, False, True, False, False, False, False, False]


def test_plans_read_once(spark):
    """An attribute's JSON is parsed once for each condition, and a parsed line once for all its fields."""
    from emberlog.plans.registry import QUERIES

    plan = lambda df: "\n".join(x for x in df._jdf.queryExecution().executedPlan().toString().split("\n") if "FileScan" not in x)
    sf = "/root/testdata/sf0.001"
    assert plan(QUERIES["p4_compare"](spark, sf)).count("from_json") <= 2
    assert plan(QUERIES["p2_equals"](spark, sf)).count("from_json") <= 1
    text = plan(QUERIES["n1_normalize"](spark, sf))
    assert text.count("from_json") <= 1 and len(text) < 60_000
    assert plan(QUERIES["e1_grok"](spark, sf)).count("regexp_extract") <= 4 and plan(QUERIES["e1_grok"](spark, sf)).count("regexp_replace") == 1


def test_grok_once(spark):
    """One run of an expression gives what a run for each group gives, also where texts hold the separator."""
    texts = ["10.0.0.1 GET /a", "x 10.0.0.1 POST /b?c tail\nmore", "no", "", None, "1.2.3.4 GET /\x01y", "\x01 nothing", "pre\n5.6.7.8 PUT /z\n"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, line string")
    for pattern in (r"%{IPV4:ip} %{WORD:verb} %{NOTSPACE:path}(?: %{WORD:rest})?", r"^%{IPV4:ip} %{WORD:verb}", r"(?P<a>\d)?(?P<b>[a-z])\Z", "^no|(?P<x>GET)"):
        java, names = G.numbered(G.expand(pattern))
        ok, caps = G.captures(F.col("line"), G.expand(pattern))
        rows = df.select("k", ok.alias("_ok"), F.coalesce(F.rlike("line", F.lit(java)), F.lit(False)).alias("_want"), *[c.alias(n) for n, c in caps.items()], *[F.coalesce(F.regexp_extract("line", java, i), F.lit("")).alias(f"want_{n}") for n, i in names.items()]).collect()
        for r in rows:
            assert r["_ok"] == r["_want"], (pattern, texts[r.k])
            assert all(r[n] == r[f"want_{n}"] for n in names), (pattern, texts[r.k])
