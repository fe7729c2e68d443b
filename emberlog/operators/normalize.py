"""Normalisation of parsed JSON records to the canonical schema."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlog.functions import scalars as S
from emberlog.schema import COLUMNS

#: Keys of each field, the first that is there counts.
ALIASES = {
    "source": ("source", "host", "hostname"),
    "service": ("service", "logger"),
    "level": ("level", "severity", "lvl"),
    "message": ("message", "msg"),
    "time": ("timestamp", "time", "ts", "@timestamp"),
    "raw": ("raw",),
}
RESERVED = {k for keys in ALIASES.values() for k in keys} | {"id", "received_at", "attributes"}
MAX_SKEW = "24 hours"


def first_present(record: Column, *keys: str) -> Column:
    """The value of the first key that is there, even if that value is empty."""
    out = F
    for k in keys:
        out = out.when(F.map_contains_key(record, k), record[k])
    return out


def scalar_text(v: Column) -> Column:
    """The text of a JSON value: a string's own, empty for null, compact JSON for the rest."""
    return F.when(S.present(v), v.cast("string")).otherwise("")


def fold(record: Column) -> Column:
    """`attributes` of a record, overwritten by its other keys that aren't reserved."""
    own = F.coalesce(F.try_variant_get(record["attributes"], "$", "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    top = F.map_filter(record, lambda k, _: ~k.isin(*sorted(RESERVED)))
    return F.map_concat(F.map_filter(own, lambda k, _: ~F.map_contains_key(top, k)), top)


def normalize(df: DataFrame, *, now: datetime, record: str = "record") -> tuple[DataFrame, DataFrame]:
    """(logs, rejects) of a map<string,variant> column; rejects have the columns of df with `reason`.

    df may carry `value` (the text that the record was read from) and `error` (a reason it was refused before).
    """
    # in steps, each computed once: in one, a filter on the reason repeats the parsing, and code grows too large to compile
    r, at = F.col("_record.r"), F.lit(now)
    parsed = S.once(df, "_record", F.struct(F.col(record).alias("r")))
    parsed = S.once(parsed, "_found", F.struct(*[first_present(r, *keys).alias(name) for name, keys in ALIASES.items()]))
    texts = [F.coalesce(scalar_text(F.col("_found")[name]), F.lit("")).alias(name) for name in ALIASES if name != "time"]
    parsed = S.once(parsed, "_text", F.struct(*texts, S.time_text(F.col("_found.time")).alias("time")))
    text = lambda name: F.col("_text")[name]
    parsed = S.once(parsed, "_ts", S.time_of(text("time")))
    early = F.col("error") if "error" in df.columns else F.lit(None).cast("string")
    reason = (
        F.when(early.isNotNull(), early)
        .when(r.isNull(), "not a JSON object")
        .when(F.col("_ts").isNull() & (text("time") != ""), "invalid timestamp")
        .when(F.col("_ts") > at + F.expr(f"INTERVAL {MAX_SKEW}"), f"invalid timestamp: more than {MAX_SKEW} in the future")
    )
    parsed = parsed.withColumn("reason", reason)
    ts = F.coalesce(F.col("_ts"), at)
    seed = [F.col("value")] if "value" in df.columns else [F.to_json(r)]
    seed += [F.col(c) for c in ("file", "line_no") if c in df.columns]
    logs = parsed.where("reason is null").select(
        S.event_id(at, *seed).alias("id"),
        ts.alias("ts"),
        at.cast("timestamp").alias("received_at"),
        text("source").alias("source"),
        text("service").alias("service"),
        S.level_norm(text("level")).alias("level"),
        text("message").alias("message"),
        fold(r).alias("attributes"),
        text("raw").alias("raw"),
    )
    return logs.select(*COLUMNS), parsed.where("reason is not null").drop("_ts", "_text", "_found", "_record", record)


def flatten_dotted(df: DataFrame, column: str) -> Column:
    """map<string,string> of a struct's leaves by dotted names, nulls left out."""

    def leaves(kind: T.DataType, col: Column, path: tuple[str, ...]) -> list[tuple[str, Column]]:
        if isinstance(kind, T.StructType):
            return [x for f in kind for x in leaves(f.dataType, col[f.name], (*path, f.name))]
        return [(".".join(path), col.cast("string"))]

    pairs = leaves(df.schema[column].dataType, F.col(column), ())
    whole = F.map_from_arrays(F.array(*[F.lit(k) for k, _ in pairs]), F.array(*[c for _, c in pairs]))
    return F.map_filter(whole, lambda _, v: v.isNotNull())
