"""Queries of sources, normalisation, parsing stages, scalars and alert parts (see registry)."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.functions import predicates as P
from emberlog.functions import scalars as S
from emberlog.operators import aggregate as A
from emberlog.operators import alerts as R
from emberlog.operators import normalize as N
from emberlog.operators import paging as L
from emberlog.operators import pipelines as E
from emberlog.operators import sinks as K
from emberlog.plans.registry import COUNT_RULE, DEAD_RULE, TICKS_SQL, at, evals_sql, plain, register, shared, tbl, whole
from emberlog.schema import events
from emberlog.sources import otlp, readers, syslog
from emberlog.streaming import streams as W

NOW = at(60)
PER_FILE = 2000  # records of a file that is read whole


def text_files(s: SparkSession, lines: DataFrame, **options) -> str:
    """A folder of text files of the column `value`."""
    path = f"{shared(s)}/text-{uuid.uuid4().hex}"
    lines.select("value").write.options(**options).text(path)
    return path


def as_records(s: SparkSession, d: str) -> DataFrame:
    """value: the events as JSON records under alias keys."""
    e = events(s, d)
    fields = [F.col("source").alias("host"), F.col("service").alias("logger"), F.upper("level").alias("severity"), F.col("message").alias("msg"), F.unix_millis("ts").alias("time"), F.col("id").alias("ref")]
    return e.select("id", F.to_json(F.struct(*fields)).alias("value"))


READ_SQL = "SELECT id AS ref, source, service, level, message FROM logs"


def shown(logs: DataFrame) -> DataFrame:
    return logs.select(S.attr_text(S.attr("ref")).alias("ref"), "source", "service", "level", "message")


# Sources


@register("s1_ndjson", READ_SQL)
def _(s, d):
    return shown(readers.read_ndjson(s, text_files(s, as_records(s, d)), now=NOW)[0])


@register("s7_gzip", READ_SQL)
def _(s, d):
    return shown(readers.read_ndjson(s, text_files(s, as_records(s, d), compression="gzip"), now=NOW)[0])


@register("s2_json_array", READ_SQL)
def _(s, d):
    groups = as_records(s, d).groupBy(F.floor(F.col("id").cast("long") / PER_FILE).alias("g")).agg(F.concat(F.lit("["), F.array_join(F.collect_list("value"), ","), F.lit("]")).alias("value"))
    path = f"{shared(s)}/arrays-{uuid.uuid4().hex}"
    groups.repartition("g").write.partitionBy("g").text(path)
    return shown(readers.read_json_array(s, path, now=NOW)[0])


@register("s3_json_multiline", READ_SQL)
def _(s, d):
    spread = as_records(s, d).select(F.replace(F.col("value"), F.lit(',"'), F.lit(',\n  "')).alias("value"))
    files = spread.count() // PER_FILE + 1
    return shown(readers.read_json_multiline(s, text_files(s, spread.repartition(files)), now=NOW)[0])


@register("s2_broken_array", f"{READ_SQL} WHERE event_id % {PER_FILE} < 1500 OR event_id // {PER_FILE} % 2 = 0")
def _(s, d):
    """Every second array has an element that is no JSON; what comes before it is taken."""
    k, g = F.col("id").cast("long"), F.floor(F.col("id").cast("long") / PER_FILE)
    broken = as_records(s, d).withColumn("value", F.when((k % PER_FILE == 1500) & (g % 2 == 1), "{oops}").otherwise(F.col("value")))
    groups = broken.groupBy(g.alias("g")).agg(F.array_sort(F.collect_list(F.struct("id", "value"))).alias("rows"))  # PER_FILE rows at most
    path = f"{shared(s)}/arrays-{uuid.uuid4().hex}"
    groups.select("g", F.concat(F.lit("["), F.array_join(F.transform("rows", lambda r: r["value"]), ","), F.lit("]")).alias("value")).repartition("g").write.partitionBy("g").text(path)
    return shown(readers.read_json(s, path, now=NOW)[0])


@register("s3_broken_lines", "SELECT CASE WHEN event_id % 7 = 0 THEN 'rejected' ELSE 'accepted' END AS outcome, count(*) AS count FROM events GROUP BY 1", logs=False)
def _(s, d):
    """Values over lines, of which some lines are none."""
    k = F.col("id").cast("long")
    spread = as_records(s, d).select(F.when(k % 7 == 0, "no json here").otherwise(F.replace(F.col("value"), F.lit(',"'), F.lit(',\n  "'))).alias("value"))
    return A.observe_counts(*readers.read_json(s, text_files(s, spread), now=NOW)).where("count > 0")


@register("s4_raw_text", "SELECT message, message AS raw, 'svc' AS service, 'src' AS source, 'info' AS level FROM logs")
def _(s, d):
    path = text_files(s, events(s, d).select(F.concat("message", F.lit("\r")).alias("value")))
    return readers.read_raw(s, path, "svc", "src", now=NOW).select("message", "raw", "service", "source", "level")


@register("s9_file_tail", "SELECT message AS value FROM logs")
def _(s, d):
    path, out = text_files(s, events(s, d).select(F.col("message").alias("value"))), f"{shared(s)}/tail-{uuid.uuid4().hex}"
    W.tail_files(s, path).select("value").writeStream.option("checkpointLocation", f"{out}/ck").trigger(availableNow=True).format("parquet").start(f"{out}/rows").awaitTermination()
    return s.read.schema("value string").parquet(f"{out}/rows")


@register("s10_merge", "SELECT level, message FROM logs UNION ALL SELECT 'info', message FROM logs")
def _(s, d):
    e = events(s, d)
    raw = readers.of_raw(e.select(F.col("message").alias("value")), "svc", "src", now=NOW)
    return readers.merge_logs(e, raw).select("level", "message")


@register("s11_size_limit", "SELECT CASE WHEN octet_length(encode(regexp_replace(text, '[^a-z ]', '', 'g'))) + 10 <= 2000 THEN 'accepted' ELSE 'rejected' END AS outcome, count(*) AS count FROM documents GROUP BY 1", logs=False)
def _(s, d):
    lines = tbl(s, d, "documents").select(F.concat(F.lit('{"msg":"'), F.regexp_replace("text", "[^a-z ]", ""), F.lit('"}')).alias("value"))
    return A.observe_counts(*readers.parse_lines(lines, now=NOW, max_bytes=2000)).where("count > 0")


# Sinks


@register("k3_export_json", "SELECT id, message FROM logs WHERE level = 'error'")
def _(s, d):
    found, path = P.search(events(s, d), [("level", "=", "error")]), f"{shared(s)}/export-{uuid.uuid4().hex}"
    K.export_json_array(found, path)
    return K.read_json_array_lines(s, path, "id string, message string")


@register("k7_rejects", "SELECT event_id, 'invalid timestamp' AS reason FROM events WHERE event_id % 5 = 0", logs=False)
def _(s, d):
    stamp = F.when(F.col("event_id") % 5 == 0, F.lit("yesterday")).otherwise("2024-01-02T00:00:00Z")
    lines = tbl(s, d, "events").select("event_id", F.to_json(F.struct(stamp.alias("ts"))).alias("value"))
    path = f"{shared(s)}/rejects-{uuid.uuid4().hex}"
    K.write_rejects(readers.parse_lines(lines, now=NOW)[1], path, "b1", NOW)
    return s.read.schema("event_id long, reason string").json(path).select("event_id", "reason")


# Normalisation


def record(s: SparkSession, d: str, *fields) -> DataFrame:
    """event_id and `record`, the map of a JSON object of the fields."""
    return tbl(s, d, "events").select("event_id", F.from_json(F.to_json(F.struct(*fields)), "map<string,variant>").alias("record"))


@register("n2_fold_unknown", "SELECT event_id, event_type AS a, user_id::VARCHAR AS b FROM events", logs=False)
def _(s, d):
    r = record(s, d, F.struct(F.lit("old").alias("a"), F.col("user_id").alias("b")).alias("attributes"), F.col("event_type").alias("a"), F.lit("h").alias("host"))
    folded = r.select("event_id", N.fold(F.col("record")).alias("m"))
    return folded.where(~F.map_contains_key("m", "host")).select("event_id", S.attr_text(F.col("m")["a"]).alias("a"), S.attr_text(F.col("m")["b"]).alias("b"))


@register("n3_scalar_text", "SELECT event_id, event_type AS s, user_id::VARCHAR AS n, '[' || user_id || ',1]' AS a FROM events", logs=False)
def _(s, d):
    r = record(s, d, F.col("event_type").alias("s"), F.col("user_id").alias("n"), F.array("user_id", F.lit(1)).alias("a"))
    return r.select("event_id", *[N.scalar_text(F.col("record")[k]).alias(k) for k in ("s", "n", "a")])


@register("n6_ts_parse", "SELECT event_id, CASE event_id % 3 WHEN 2 THEN NULL ELSE date_trunc('second', ts) END AS ts, event_id % 3 <> 2 OR event_id % 2 = 0 AS ok FROM events", logs=False)
def _(s, d):
    ts, k = F.col("ts").cast("timestamp"), F.col("event_id") % 3
    text = F.when(k == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k == 1, F.unix_seconds(ts).cast("string")).otherwise(F.when(F.col("event_id") % 2 == 0, "  ").otherwise("yesterday"))
    parsed = tbl(s, d, "events").select("event_id", S.ts_parse(text.cast("variant")).alias("p"))
    return plain(parsed.select("event_id", "p.ts", "p.ok"))


@register("n8_future_skew", "SELECT event_id FROM events WHERE ts <= TIMESTAMP '2024-01-10 00:00:00'", logs=False)
def _(s, d):
    ts = F.col("ts").cast("timestamp")
    e = record(s, d, ts.alias("ignored"), F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("time"), F.col("event_id").alias("ref"))
    return N.normalize(e, now=at(8))[0].select(S.attr_text(S.attr("ref")).cast("long").alias("event_id"))


@register("n9_default_times", "SELECT event_id, TIMESTAMP '2024-03-01' AS ts, TIMESTAMP '2024-03-01' AS received_at FROM events", logs=False)
def _(s, d):
    logs = N.normalize(record(s, d, F.col("event_id").alias("ref")), now=at(60))[0]
    return plain(logs.select(S.attr_text(S.attr("ref")).cast("long").alias("event_id"), "ts", "received_at"))


@register("n10_event_id", "SELECT ts, count(*) AS ids, 1::BIGINT AS heads, 26 AS width FROM events GROUP BY ts", logs=False)
def _(s, d):
    e = tbl(s, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), S.event_id(F.col("ts").cast("timestamp"), F.col("event_id")).alias("id"))
    return plain(e.groupBy("ts").agg(F.count_distinct("id").alias("ids"), F.count_distinct(F.substring("id", 1, 10)).alias("heads"), F.max(F.length("id")).alias("width")))


@register("n12_flatten", "SELECT event_id, event_type AS a, user_id::VARCHAR AS b FROM events", logs=False)
def _(s, d):
    df = tbl(s, d, "events").select("event_id", F.struct(F.struct(F.col("event_type").alias("type"), F.struct(F.col("user_id").alias("id")).alias("user")).alias("http")).alias("g"))
    m = N.flatten_dotted(df, "g")
    return df.select("event_id", m["http.type"].alias("a"), m["http.user.id"].alias("b"))


@register("n13_drop_empty", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 1 ELSE 2 END AS n FROM events", logs=False)
def _(s, d):
    r = record(s, d, F.when(F.col("event_id") % 2 == 0, "").otherwise("x").alias("a"), F.lit(0).alias("b"))
    return r.select("event_id", F.size(S.drop_empty(F.col("record"))).alias("n"))


# Scalars


@register("a1_attr_text", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '1' ELSE '0' END AS flag, user_id::VARCHAR AS n, '500' AS x FROM events", logs=False)
def _(s, d):
    r = record(s, d, (F.col("event_id") % 2 == 0).alias("flag"), F.col("user_id").alias("n"), F.lit(500.0).alias("x"))
    return r.select("event_id", *[S.attr_text(F.col("record")[k]).alias(k) for k in ("flag", "n", "x")])


@register("a3_regex", "SELECT id FROM logs WHERE regexp_matches(message, 'user \\d+5$')")
def _(s, d):
    return P.search(events(s, d), [("message", "regex", r"user \d+5$")]).select("id")


@register("a10_hex", "SELECT doc_id, lower(hex(encode(lang))) AS h FROM documents", logs=False)
def _(s, d):
    return tbl(s, d, "documents").select("doc_id", S.hex_of(F.encode("lang", "utf-8")).alias("h"))


@register("a12_type_test", "SELECT event_id, event_id % 2 = 0 AS is_bool FROM events", logs=False)
def _(s, d):
    v = F.when(F.col("event_id") % 2 == 0, F.lit(True).cast("variant")).otherwise(F.lit("true").cast("variant"))
    return tbl(s, d, "events").select("event_id", S.is_bool(v).alias("is_bool"))


@register("a13_nested_text", "SELECT '{\"a\":' || (user_id % 10) || '}' AS o, count(*) AS count FROM events GROUP BY 1", logs=False)
def _(s, d):
    r = record(s, d, F.struct((F.col("user_id") % 10).alias("a")).alias("o")).withColumnRenamed("record", "attributes")
    return A.stats(r, [("count",)], ["attr.o"])


@register("p12_bounds", "SELECT id FROM logs WHERE ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-08'")
def _(s, d):
    start, end = P.resolve_bounds((at(4), None), (at(1), at(7)), at(20))
    return P.search(events(s, d), start=start, end=end).select("id")


@register("g16_bucket_width", "SELECT make_timestamp((epoch_us(ts) // 21600000000) * 21600000000) AS bucket, count(*) AS count FROM logs GROUP BY ALL")
def _(s, d):
    return plain(A.histogram(events(s, d), A.bucket_for("168h")))


@register("l4_first_of", "SELECT source, array_to_string(list_slice(l, 1, 5), chr(10)) || CASE WHEN len(l) > 5 THEN chr(10) || '…and ' || (len(l) - 5) || ' more' ELSE '' END AS text FROM (SELECT source, list(id ORDER BY id) AS l FROM logs GROUP BY source)")
def _(s, d):
    return L.first_rows(events(s, d), "source", "id").select("source", L.first_of(F.col("items"), total=F.col("total")).alias("text"))


# Parsing stages


def _stages(s: SparkSession, d: str, *stages: E.Stage) -> DataFrame:
    return E.dry_run(events(s, d), [E.Pipeline("p", stages)])


@register("e3_capture_routing", "SELECT id, CASE WHEN level = 'error' THEN 'error' ELSE 'info' END AS level, 'user' AS service, user_id::VARCHAR AS n FROM logs")
def _(s, d):
    out = _stages(s, d, E.Stage("grok", pattern="%{WORD:level} by %{WORD:service} %{INT:n}"))
    return out.select("id", "level", "service", S.attr_text(S.attr("n")).alias("n"))


@register("e4_coercion", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'DOUBLE' ELSE 'STRING' END AS kind FROM events", logs=False)
def _(s, d):
    k = F.col("event_id") % 4
    text = F.when(k == 0, F.concat(F.lit("1"), F.col("user_id").cast("string"), F.lit(".5"))).when(k == 1, "007").when(k == 2, "1e5").otherwise("0x1f")
    return tbl(s, d, "events").select("event_id", F.schema_of_variant(S.of_text(text)).alias("kind"))


@register("e7_service_stage", "SELECT id, source AS service FROM logs")
def _(s, d):
    return _stages(s, d, E.Stage("service", "host")).select("id", "service")


@register("e8_rename_remove_set", "SELECT id, k_text AS renamed, NULL::VARCHAR AS k, 'prod' AS env FROM logs")
def _(s, d):
    out = _stages(s, d, E.Stage("rename", "attr.k", to="renamed"), E.Stage("remove", fields=("attr.none",)), E.Stage("set", to="env", value="prod"))
    return out.select("id", *[S.attr_text(S.attr(k)).alias(k) for k in ("renamed", "k", "env")])


@register("e9_dry_run", "SELECT id, 1 AS n_matched, CASE WHEN service = 'error' THEN 0 ELSE 1 END AS n_errors FROM logs")
def _(s, d):
    out = _stages(s, d, E.Stage("grok", pattern="^error by %{WORD:who}"))
    return out.select("id", F.size("matched").alias("n_matched"), F.size("errors").alias("n_errors"))


@register("e11_field_read", "SELECT id, true AS raw_missing, k_text IS NULL AS k_missing FROM logs")
def _(s, d):
    return events(s, d).select("id", E.read_field("raw").isNull().alias("raw_missing"), E.read_field("attr.k").isNull().alias("k_missing"))


# Syslog and OpenTelemetry


def _line(s: SparkSession, d: str, *parts) -> DataFrame:
    text = F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    return syslog.parse_syslog(tbl(s, d, "events").select(text.alias("value")), now=NOW)


@register("y2_rfc5424", "SELECT 'h' || user_id AS source, event_type AS service, event_id::VARCHAR AS procid, 'M' || (event_id % 3) AS msgid, 'local' || (event_id % 8) AS facility FROM events", logs=False)
def _(s, d):
    u, e = F.col("user_id"), F.col("event_id")
    out = _line(s, d, "<", (16 + e % 8) * 8 + 6, ">1 2024-01-01T00:00:00Z h", u, " ", F.col("event_type"), " ", e, " M", e % 3, " - text")
    return out.select("source", "service", *[S.attr_text(S.attr(k)).alias(k) for k in ("procid", "msgid", "facility")])


@register("y3_structured_data", "SELECT 'br]' || user_id AS x, event_id::VARCHAR AS y, 'true' AS z, 'tail' AS message FROM events", logs=False)
def _(s, d):
    out = _line(s, d, '<14>1 2024-01-01T00:00:00Z h a - - [a x="br]', F.col("user_id"), '" y="', F.col("event_id"), '"][b] tail')
    return out.select(S.attr_text(S.attr("a.x")).alias("x"), S.attr_text(S.attr("a.y")).alias("y"), S.attr_text(S.attr("b")).alias("z"), "message")


@register("y4_rfc3164", "SELECT 'h' || user_id AS source, event_type AS service, event_id::VARCHAR AS procid, 'said it' AS message, date_trunc('second', ts) AS ts FROM events", logs=False)
def _(s, d):
    stamp = F.date_format(F.col("ts").cast("timestamp"), "MMM d HH:mm:ss")
    out = _line(s, d, "<13>", stamp, " h", F.col("user_id"), " ", F.col("event_type"), "[", F.col("event_id"), "]: said it")
    return plain(out.select("source", "service", S.attr_text(S.attr("procid")).alias("procid"), "message", "ts"))


@register("y5_malformed", "SELECT CASE event_id % 2 WHEN 0 THEN 'no priority ' ELSE '<999> bad ' END || event_id AS message, 'info' AS level FROM events", logs=False)
def _(s, d):
    return _line(s, d, F.when(F.col("event_id") % 2 == 0, "no priority ").otherwise("<999> bad "), F.col("event_id"), "\r\n").select("message", "level")


def _otlp(s: SparkSession, d: str, record_: list, resource: list | None = None) -> DataFrame:
    kv = lambda k, v: F.struct(F.lit(k).alias("key"), F.struct(v).alias("value"))
    joined = lambda pairs: F.concat(F.lit("["), F.concat_ws(",", *[F.to_json(kv(k, v)) for k, v in pairs]), F.lit("]"))
    body = F.concat(F.lit('{"resource_logs":[{"resource":{"attributes":'), joined(resource or []) if resource else F.lit("[]"), F.lit('},"scope_logs":[{"scope":{"name":"scope"},"log_records":[{"observed_time_unix_nano":"'), (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).cast("string"), F.lit('","trace_id":"t1","body":{"string_value":"b"},"attributes":'), joined(record_), F.lit("}]}]}]}"))
    return otlp.parse_otlp_json(tbl(s, d, "events").select(body.alias("value")), now=NOW)


@register("y6_otlp_service", "SELECT 'd' || user_id AS service, 'pod' AS source FROM events", logs=False)
def _(s, d):
    out = _otlp(s, d, [("x", F.lit("1").alias("stringValue"))], [("k8s.deployment.name", F.concat(F.lit("d"), F.col("user_id").cast("string")).alias("stringValue")), ("k8s.pod.name", F.lit("pod").alias("stringValue"))])
    return out.select("service", "source")


@register("y7_otlp_merge", "SELECT event_id::VARCHAR AS x, 'kept' AS y, 't1' AS trace_id FROM events", logs=False)
def _(s, d):
    out = _otlp(s, d, [("x", F.col("event_id").cast("string").alias("stringValue"))], [("x", F.lit("resource").alias("stringValue")), ("y", F.lit("kept").alias("stringValue"))])
    return out.select(*[S.attr_text(S.attr(k)).alias(k) for k in ("x", "y", "trace_id")])


@register("y8_otlp_times", "SELECT event_id::VARCHAR AS x, ts, ts AS received_at FROM events", logs=False)
def _(s, d):
    return plain(_otlp(s, d, [("x", F.col("event_id").cast("string").alias("stringValue"))]).select(S.attr_text(S.attr("x")).alias("x"), "ts", "received_at"))


@register("y9_any_value", "SELECT user_id::VARCHAR AS i, CASE WHEN event_id % 2 = 0 THEN '1' ELSE '0' END AS b, '[\"' || event_type || '\"]' AS l FROM events", logs=False)
def _(s, d):
    listed = F.struct(F.array(F.struct(F.col("event_type").alias("stringValue"))).alias("values")).alias("arrayValue")
    out = _otlp(s, d, [("i", F.col("user_id").cast("string").alias("intValue")), ("b", (F.col("event_id") % 2 == 0).alias("boolValue")), ("l", listed)])
    return out.select(*[S.attr_text(S.attr(k)).alias(k) for k in ("i", "b", "l")])


# Alerts and streams


@register("r1_condition", "SELECT event_id, k > 50 AS gt, k >= 50 AS gte, k < 50 AS lt, k <= 50 AS lte, k = 50 AS eq, k <> 50 AS ne FROM logs")
def _(s, d):
    k = F.get_json_object("props", "$.k").cast("double")
    return tbl(s, d, "events").select("event_id", *[R.condition(k, op, 50).alias(op) for op in R.OPS])


@register("r4_reported_value", """SELECT op, CASE WHEN op IN ('lt', 'lte') THEN min(c) ELSE max(c) END::DOUBLE AS value
FROM (SELECT count(*) AS c FROM logs WHERE ts BETWEEN '2024-01-04' AND '2024-01-05' GROUP BY service), (VALUES ('gt'), ('lt'), ('lte'), ('ne')) t(op) GROUP BY op""")  # fmt: skip
def _(s, d):
    out = None
    for op in ("gt", "lt", "lte", "ne"):
        rule = R.Rule(op, op, op, 1, by=("service",), window_s=86400, interval_s=3600)
        part = R.evaluate(events(s, d), rule, at(4)).select(F.col("rule_id").alias("op"), "value")
        out = part if out is None else out.unionByName(part)
    return out


@register("r5_dead_man", f"""SELECT "at", coalesce(min(v), 0) AS value, coalesce(min(v), 0) < 20 AS firing
FROM ({TICKS_SQL.format(i=900)}) LEFT JOIN (SELECT "at" AS a2, source, avg(k) AS v FROM ({TICKS_SQL.format(i=900)}) JOIN logs ON service = 'purchase' AND ts BETWEEN "at" - INTERVAL 900 SECOND AND "at" GROUP BY ALL) ON a2 = "at" GROUP BY "at" """)  # fmt: skip
def _(s, d):
    rule = R.Rule("dead", "Dead", "lt", 20, (("service", "=", "purchase"),), measure=("avg", "attr.k"), by=("source",), window_s=900, interval_s=900)
    return plain(R.backtest_rule(events(s, d), rule, *whole(s, d)).select("at", "value", "firing"))


@register("r10_group_label", "SELECT id, 'level=' || level || ' service=' || service AS label FROM logs")
def _(s, d):
    return events(s, d).select("id", R.group_label(F.create_map(F.lit("service"), "service", F.lit("level"), "level")).alias("label"))


@register("j2_rule_channels", f"""SELECT "at", c.channel, c.channel = 'gone' AS missing FROM (SELECT "at", firing, lag(firing) OVER (ORDER BY "at") AS before FROM ({evals_sql(COUNT_RULE, "level = 'error'")})) t, (VALUES ('mail'), ('gone')) c(channel)
WHERE CASE WHEN firing THEN coalesce(NOT before, true) ELSE coalesce(before, false) END""")  # fmt: skip
def _(s, d):
    channels = s.createDataFrame([("mail", "webhook", "u")], "id string, type string, url string")
    turned = R.transitions(R.backtest(events(s, d), [COUNT_RULE], *whole(s, d)))
    return plain(R.notifications(turned, [COUNT_RULE], channels).select("at", "channel", "missing"))


@register("j4_ticks", f"""SELECT "at", count(*)::DOUBLE AS value FROM ({TICKS_SQL.format(i=600)}) JOIN logs ON ts BETWEEN "at" - INTERVAL 30 MINUTE AND "at" GROUP BY "at" """)
def _(s, d):
    rule = R.Rule("all", "All", "gt", 0, window_s=1800, interval_s=600)
    return plain(R.backtest_rule(events(s, d), rule, *whole(s, d)).where("value > 0").select("at", "value"))


@register("j3_pipelines_in_order", "SELECT id, CASE WHEN service = 'error' THEN 'b' ELSE 'a' END AS mark FROM logs")
def _(s, d):
    a = E.Pipeline("a", (E.Stage("set", to="mark", value="a"),), order=1)
    b = E.Pipeline("b", (E.Stage("set", to="mark", value="b"),), match=(("service", "=", "error"), ("attr.mark", "=", "a")), order=2)
    off = E.Pipeline("off", (E.Stage("set", to="mark", value="off"),), enabled=False, order=3)
    return E.apply_pipelines(events(s, d), [off, b, a]).select("id", S.attr_text(S.attr("mark")).alias("mark"))


@register("w2_backfill_tail", "SELECT id FROM logs")
def _(s, d):
    work = f"{shared(s)}/follow-{uuid.uuid4().hex}"
    events(s, d).write.parquet(f"{work}/in")
    history = s.read.parquet(f"{work}/in").where(F.col("ts") < F.lit(at(15)))
    W.backfill_then_tail(history, W.read_logs_stream(s, f"{work}/in"), lambda b, k: b.select("id").write.mode("overwrite").parquet(f"{work}/out/batch={k}"), f"{work}/ck").awaitTermination()
    return s.read.parquet(f"{work}/out").select("id")


@register("w8_alert_states", f"""SELECT "at", CASE WHEN firing THEN 'firing' ELSE 'ok' END AS state, CASE WHEN firing THEN coalesce(NOT before, true) ELSE coalesce(before, false) END AS notify
FROM (SELECT "at", firing, lag(firing) OVER (ORDER BY "at") AS before FROM ({evals_sql(COUNT_RULE, "level = 'error'")}))""")  # fmt: skip
def _(s, d):
    work = f"{shared(s)}/states-{uuid.uuid4().hex}"
    evaluations = R.backtest(events(s, d), [COUNT_RULE], *whole(s, d)).select("rule_id", "at", "firing", F.lit(None).cast("string").alias("error"))
    evaluations.coalesce(1).write.parquet(f"{work}/in")
    states = W.alert_state_stream(s.readStream.schema(evaluations.schema).parquet(f"{work}/in"))
    states.writeStream.option("checkpointLocation", f"{work}/ck").trigger(availableNow=True).format("parquet").start(f"{work}/out").awaitTermination()
    return plain(s.read.schema(states.schema).parquet(f"{work}/out").select("at", "state", "notify"))


@register("r8_validated_rules", evals_sql(COUNT_RULE, "level = 'error'") + "\nUNION ALL " + evals_sql(DEAD_RULE, "service = 'purchase'"))
def _(s, d):
    bad = [replace(COUNT_RULE, id=f"bad{k}", **x) for k, x in enumerate(({"interval_s": 1}, {"window_s": 31 * 86400}, {"op": "about"}, {"severity": "loud"}, {"window_s": 60}))]
    return plain(R.backtest(events(s, d), R.valid([COUNT_RULE, *bad, DEAD_RULE]), *whole(s, d)).drop("groups"))


@register("e10_validated_pipelines", "SELECT id, 'good' AS mark FROM logs")
def _(s, d):
    made = [E.Pipeline("good", (E.Stage("set", to="mark", value="good"),)), E.Pipeline("none", ()), E.Pipeline("loop", (E.Stage("grok", pattern="%{NOPE:x}"),)), E.Pipeline("odd", (E.Stage("sing"),)), E.Pipeline("bad", (E.Stage("regex", pattern="(?P<x>["),))]
    return E.apply_pipelines(events(s, d), E.valid(made)).select("id", S.attr_text(S.attr("mark")).alias("mark"))
