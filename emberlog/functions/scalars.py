"""Scalar functions: Columns to Columns, and helpers for literals."""

from __future__ import annotations

import base64
import re
from collections.abc import Callable
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMBER = re.compile(r"[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\Z")
PREFIX = r"^\s*([+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?)"
RFC3339 = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"
TYPED = "attr:"  # columns of attributes that are stored by themselves: this and the key hold the text, with `#` behind it the number
ABSENT = "\x00"  # the text of a row without the attribute; null where a file doesn't have the column
LEVELS = ("debug", "info", "warn", "error", "fatal")
#: Spellings of each level, syslog severities among them.
SPELLINGS = {
    "debug": ("trace", "debug", "dbg", "verbose", "7"),
    "info": ("info", "information", "informational", "notice", "5", "6"),
    "warn": ("warn", "warning", "4"),
    "error": ("err", "error", "3"),
    "fatal": ("fatal", "crit", "critical", "alert", "emerg", "emergency", "panic", "0", "1", "2"),
}


def level_norm(col: Column) -> Column:
    """The level of any usual spelling, `info` for others and null."""
    known = F.create_map(*[F.lit(x) for level, spellings in SPELLINGS.items() for s in spellings for x in (s, level)])
    return F.coalesce(F.try_element_at(known, F.lower(F.trim(col))), F.lit("info"))


def level_rank(col: Column) -> Column:
    out = F.when(col == LEVELS[1], 1)
    for k, level in enumerate(LEVELS[2:], 2):
        out = out.when(col == level, k)
    return out.otherwise(0)


def level_from(col: Column, scheme: str, text: Column | None = None) -> Column:
    """The level of a logging library's number. scheme: python, slog, pino, or otlp (text: its severity text)."""
    steps = {
        "python": ((50, "fatal"), (40, "error"), (30, "warn"), (20, "info")),
        "slog": ((12, "fatal"), (8, "error"), (4, "warn"), (0, "info")),
        "otlp": ((21, "fatal"), (17, "error"), (13, "warn"), (9, "info")),
    }
    if scheme == "pino":
        known = {10: "debug", 20: "debug", 30: "info", 40: "warn", 50: "error", 60: "fatal"}
        out = F
        for n, level in known.items():
            out = out.when(col == n, level)
        return out.otherwise("info")
    if scheme not in steps:
        raise ValueError(f"unknown scheme {scheme!r}")
    out = F
    if scheme == "otlp":
        out = F.when(F.coalesce(col, F.lit(0)) == 0, level_norm(text) if text is not None else F.lit("info"))
    for n, level in steps[scheme]:
        out = out.when(col >= n, level)
    return out.otherwise("debug")


def epoch_to_ts(col: Column) -> Column:
    """A timestamp of an epoch number: nanoseconds from 1e18, microseconds from 1e15, milliseconds from 1e12, else seconds."""
    x = col.cast("decimal(38,9)")
    micros = F.when(x >= F.lit("1e18").cast("decimal(38,9)"), x / 1000).when(x >= F.lit("1e15").cast("decimal(38,9)"), x).when(x >= F.lit("1e12").cast("decimal(38,9)"), x * 1000).otherwise(x * 1000000)
    return F.timestamp_micros(F.floor(micros).try_cast("bigint"))


def rfc3339(col: Column) -> Column:
    """A timestamp of an RFC 3339 text, null for anything else."""
    return F.when(F.rlike(col, F.lit(RFC3339)), F.try_to_timestamp(col))


def time_text(v: Column) -> Column:
    """What `time_of` reads of a variant; empty where it is missing, null or blank."""
    return F.coalesce(F.trim(v.cast("string")), F.lit(""))


def time_of(text: Column) -> Column:
    """A timestamp of RFC 3339 or of an epoch number's text, null for anything else (as the text of booleans and nested values is)."""
    number = F.when(F.rlike(text, F.lit(r"^[+-]?\d+(\.\d+)?([eE][+-]?\d+)?$")), epoch_to_ts(text.try_cast("decimal(38,9)")))
    return F.coalesce(rfc3339(text), number)


def ts_parse(v: Column) -> Column:
    """(ts, ok) of a variant: RFC 3339, or an epoch number or its text; null and blank are missing, which is ok."""
    text = time_text(v)
    return bound(text, lambda t: bound(time_of(t), lambda ts: F.struct(ts.alias("ts"), ((t == "") | ts.isNotNull()).alias("ok"))))


def event_id(ts: Column, *seed: Column) -> Column:
    """A 26-character id that sorts by time: 48 bits of milliseconds, then 80 bits of a hash of the seed, so replays agree."""
    crockford = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHJKMNPQRSTVWXYZ")
    head = F.lpad(F.conv(F.unix_millis(ts).cast("string"), 10, 32), 10, "0")
    digest = F.sha2(F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("")) for c in seed]), 256)
    tail = F.concat(*[F.lpad(F.conv(F.substring(digest, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(2)])
    return F.concat(crockford(head), crockford(tail))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once: for values that a filter would else compute for each mention."""
    return F.element_at(F.transform(F.array(value), body), 1)


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that later filters don't take apart: a generator's output, which no condition is pushed below."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def placed(df: DataFrame) -> DataFrame:
    """df with `file` and `line_no`, the place of a row, where it has none: the order of rows as they are read.

    Ids follow from them, so that equal rows stay two. Those of readers are the same however files are split.
    """
    lacking = {"file": F.lit(""), "line_no": F.monotonically_increasing_id()}
    return df.withColumns({c: v for c, v in lacking.items() if c not in df.columns}) if not {"file", "line_no"} <= set(df.columns) else df


def json_value(text: Column) -> Column:
    """The variant of a text that is one JSON value, with nothing but blanks around it, else null.

    Parsing stops at the end of the first value; a second one, that no text holds by chance, shows that nothing came before it.
    """
    mark = F.xxhash64(text)
    both = F.try_parse_json(F.concat(F.lit("["), text, F.lit("\n,"), mark.cast("string"), F.lit("]")))
    one = bound(both, lambda v: F.when(F.try_variant_get(v, "$[1]", "bigint") == mark, F.when(F.try_variant_get(v, "$[2]", "variant").isNull(), F.try_variant_get(v, "$[0]", "variant"))))
    return F.when(text.isNotNull(), one)


def attr(key: str) -> Column:
    return F.col("attributes")[key]


def present(v: Column) -> Column:
    """Whether a variant is there and not JSON null."""
    return v.isNotNull() & ~F.is_variant_null(v)


def is_bool(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v) == "BOOLEAN", F.lit(False))


def attr_text(v: Column, text: Column | None = None) -> Column:
    """The text of a variant: 1 or 0 of a boolean, null of JSON null, JSON of nested values, numbers without a trailing .0.

    text: v as a string, where a caller has that already.
    """
    text = v.cast("string") if text is None else text
    truth = text.isin("true", "false") & is_bool(v)  # the type, dear to find out, only where it matters
    return F.when(truth, F.when(text == "true", "1").otherwise("0")).when(text.endswith(".0"), F.regexp_replace(text, r"^(-?\d+)\.0$", "$1")).otherwise(text)


def real(text: Column) -> Column:
    """The number that a text begins with, 0 if it begins with none, null of null."""
    found = F.regexp_extract(text, PREFIX, 1)
    return F.when(text.isNotNull(), F.coalesce(F.nullif(found, F.lit("")).try_cast("double"), F.lit(0.0)))


def attr_real(v: Column) -> Column:
    return real(attr_text(v))


def of_text(text: Column) -> Column:
    """A variant of a text: plain decimals become numbers; leading zeros, exponents and hexadecimals stay text."""
    decimal = F.rlike(text, F.lit(r"^[-+.0-9]+$")) & ~F.rlike(text, F.lit(r"^0[^.]"))
    number = F.when(decimal, text.try_cast("double"))
    return F.when(number.isNotNull(), number.cast("variant")).otherwise(text.cast("variant"))


def set_key(attributes: Column, key: str, v: Column) -> Column:
    rest = F.map_filter(F.coalesce(attributes, F.create_map().cast("map<string,variant>")), lambda k, _: k != key)
    return F.map_concat(rest, F.create_map(F.lit(key), v))


def set_texts(attributes: Column, texts: dict[str, Column]) -> Column:
    """attributes with the values of `texts` that aren't empty, each as `of_text` has it."""
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), t.alias("t")) for k, t in texts.items()])
    fresh = F.map_from_entries(F.transform(F.filter(pairs, lambda p: p["t"] != ""), lambda p: F.struct(p["k"], of_text(p["t"]))))
    own = F.coalesce(attributes, F.create_map().cast("map<string,variant>"))
    return bound(fresh, lambda m: F.map_concat(F.map_filter(own, lambda k, _: ~F.map_contains_key(m, k)), m))


def drop_keys(attributes: Column, *keys: str) -> Column:
    return F.map_filter(attributes, lambda k, _: ~k.isin(*keys))


def drop_empty(attributes: Column) -> Column:
    """Without keys whose value is null or the empty text."""
    return F.map_filter(attributes, lambda _, v: present(v) & (F.coalesce(v.cast("string"), F.lit("x")) != ""))


def like_pattern(glob: str) -> str:
    """A LIKE pattern of a glob in which only * is special."""
    return re.sub(r"([%_\\])", r"\\\1", glob).replace("*", "%")


def duration(text: str) -> timedelta:
    """Of `30s`, `15m`, `2h` or `7d`; ValueError for others, and beyond 100 years."""
    if not (m := re.fullmatch(r"(\d+)([smhd])", text)):
        raise ValueError(f"no duration: {text!r}")
    seconds = int(m[1]) * {"s": 1, "m": 60, "h": 3600, "d": 86400}[m[2]]
    if seconds > 100 * 366 * 86400:
        raise ValueError(f"too long: {text!r}")
    return timedelta(seconds=seconds)


def absolute(text: str) -> datetime:
    """Of RFC 3339 or unix seconds."""
    if re.fullmatch(r"\d+", text):
        return datetime.fromtimestamp(int(text), UTC)
    if not re.match(RFC3339, text):
        raise ValueError(f"no time: {text!r}")
    return datetime.fromisoformat(text.upper().replace("Z", "+00:00"))


def encode_cursor(ts: datetime, id_: str) -> str:
    micros = (ts - datetime(1970, 1, 1, tzinfo=UTC)) // timedelta(microseconds=1)
    return base64.urlsafe_b64encode(f"{micros * 1000}|{id_}".encode()).decode().rstrip("=")


def decode_cursor(cursor: str) -> tuple[datetime, str]:
    try:
        nanos, _, id_ = base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)).decode().partition("|")
        return datetime(1970, 1, 1, tzinfo=UTC) + timedelta(microseconds=int(nanos) // 1000), id_
    except ValueError as e:
        raise ValueError(f"no cursor: {cursor!r}") from e


def cursor_of(ts: Column, id_: Column) -> Column:
    text = F.concat((F.unix_micros(ts) * 1000).cast("string"), F.lit("|"), id_)
    return F.rtrim(F.translate(F.base64(F.encode(text, "utf-8")), "+/", "-_"), F.lit("="))


def hex_of(binary: Column) -> Column:
    return F.lower(F.hex(binary))


def fit_width(text: Column, width: int) -> Column:
    """A text of exactly that many code points: padded with blanks, or cut and ended by an ellipsis."""
    return F.when(F.length(text) > width, F.concat(F.substring(text, 1, width - 1), F.lit("…"))).otherwise(F.rpad(text, width, " "))


def day_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def day_label(ts: Column, today: datetime) -> Column:
    away = F.datediff(F.lit(today.date()), F.to_date(ts))
    return F.when(away == 0, "Today").when(away == 1, "Yesterday").otherwise(day_key(ts))


def csv_safe(col: Column) -> Column:
    """A text that no spreadsheet takes for a formula."""
    return F.when(F.rlike(col, F.lit(r"^[=+\-@\t\r\n]")), F.concat(F.lit("'"), col)).otherwise(col)
