"""OpenTelemetry logs in JSON: resource, scope and record flattened to the canonical schema."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.functions import scalars as S

LIST = "array<variant>"
#: Resource attributes that name a service or a source, in order.
SERVICE = ("service.name", "service_name", "k8s.deployment.name", "k8s.container.name")
SOURCE = ("host.name", "host", "k8s.pod.name", "k8s.node.name")


def _get(v: Column, kind: str, *names: str) -> Column:
    """A member under any of its names: camel or snake case."""
    return F.coalesce(*[F.try_variant_get(v, f"$.{n}", kind) for n in names])


def any_value(v: Column, depth: int = 2) -> Column:
    """The plain variant of a tagged value; lists and maps are unwrapped to `depth` levels, below that kept as they are."""
    whole = _get(v, "string", "intValue", "int_value").try_cast("bigint").cast("variant")
    plain = F.coalesce(
        *[_get(v, "variant", f"{n}Value", f"{n}_value") for n in ("string", "bool")],
        whole,
        _get(v, "double", "doubleValue", "double_value").cast("variant"),
        _get(v, "variant", "bytesValue", "bytes_value"),
    )
    if depth == 0:
        return F.coalesce(plain, v)
    items = F.coalesce(_get(v, LIST, "arrayValue.values", "array_value.values"))
    entries = F.coalesce(_get(v, LIST, "kvlistValue.values", "kvlist_value.values"))
    listed = F.to_variant_object(F.transform(items, lambda x: any_value(x, depth - 1)))
    mapped = F.to_variant_object(attributes(entries, depth - 1))
    return F.coalesce(plain, F.when(items.isNotNull(), listed), F.when(entries.isNotNull(), mapped))


def attributes(entries: Column, depth: int = 2) -> Column:
    """map<string,variant> of a list of keys and values; of repeated keys the last counts."""
    pairs = F.transform(F.coalesce(entries, F.array().cast(LIST)), lambda e: F.named_struct(F.lit("k"), _get(e, "string", "key"), F.lit("v"), any_value(_get(e, "variant", "value"), depth)))
    keys = F.array_distinct(F.transform(F.filter(pairs, lambda p: p["k"].isNotNull()), lambda p: p["k"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(pairs, lambda p: p["k"] == k), -1)["v"]))


def _first(source: Column, keys: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.nullif(source[k].cast("string"), F.lit("")) for k in keys])


def _nanos(v: Column, *names: str) -> Column:
    n = _get(v, "string", *names).try_cast("bigint")
    return F.timestamp_micros(F.floor(F.when(n > 0, n).cast("decimal(20,0)") / F.lit(1000)).cast("bigint"))


def parse_otlp_json(df: DataFrame, col: str = "value", *, now: datetime) -> DataFrame:
    """Logs of a column with an export request in each row; ids follow from its place, see `S.placed`."""
    at = F.lit(now).cast("timestamp")
    body = S.placed(df).select(F.try_parse_json(col).alias("b"), F.struct("file", "line_no", F.col(col).alias("text")).alias("value"))
    resources = body.select("value", F.posexplode(_get(F.col("b"), LIST, "resourceLogs", "resource_logs")).alias("i", "r"))
    scopes = resources.select("value", "i", attributes(_get(F.col("r"), LIST, "resource.attributes")).alias("resource"), F.posexplode(_get(F.col("r"), LIST, "scopeLogs", "scope_logs")).alias("j", "s"))
    records = scopes.select("value", "i", "j", "resource", F.try_variant_get("s", "$.scope.name", "string").alias("scope"), F.posexplode(_get(F.col("s"), LIST, "logRecords", "log_records")).alias("k", "l"))
    log = F.col("l")
    ids = {"trace_id": _get(log, "string", "traceId", "trace_id"), "span_id": _get(log, "string", "spanId", "span_id")}
    traced = F.map_filter(F.create_map(*[x for k, v in ids.items() for x in (F.lit(k), F.nullif(v, F.lit("")))]), lambda _, v: v.isNotNull())
    own = attributes(_get(log, LIST, "attributes"))
    rows = records.withColumns({"own": own, "traced": F.transform_values(traced, lambda _, v: v.cast("variant"))})
    mine = F.map_concat(F.map_filter("own", lambda k, _: ~F.map_contains_key(F.col("traced"), k)), F.col("traced"))
    rows = rows.withColumn("mine", mine)
    said = any_value(_get(log, "variant", "body"))
    observed = _nanos(log, "observedTimeUnixNano", "observed_time_unix_nano")
    return rows.select(
        S.event_id(at, F.col("value.file"), F.col("value.line_no"), F.col("value.text"), F.col("i"), F.col("j"), F.col("k")).alias("id"),
        F.coalesce(_nanos(log, "timeUnixNano", "time_unix_nano"), observed, at).alias("ts"),
        F.coalesce(observed, at).alias("received_at"),
        F.coalesce(_first(F.col("resource"), SOURCE), F.lit("")).alias("source"),
        F.coalesce(_first(F.col("resource"), SERVICE), F.col("scope"), F.lit("")).alias("service"),
        S.level_from(_get(log, "string", "severityNumber", "severity_number").try_cast("int"), "otlp", _get(log, "string", "severityText", "severity_text")).alias("level"),
        F.coalesce(S.attr_text(said), F.lit("")).alias("message"),
        F.map_concat(F.map_filter("resource", lambda k, _: ~F.map_contains_key(F.col("mine"), k)), F.col("mine")).alias("attributes"),
        F.lit("").alias("raw"),
    )
