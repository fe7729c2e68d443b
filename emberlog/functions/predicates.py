"""Predicates of a search: fields by name, and their conjunction with terms and time bounds."""

from __future__ import annotations

import operator
import re
from collections.abc import Collection, Iterable, Sequence
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.functions import scalars as S
from emberlog.functions import text as X
from emberlog.functions.dialect import translate
from emberlog.functions.scalars import ABSENT, TYPED

#: Names of columns and their aliases.
FIELDS = {"level": "level", "service": "service", "source": "source", "host": "source", "message": "message", "msg": "message", "raw": "raw"}
COMPARE = {">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le}
NAMED = re.compile(r"(?<!\\)\(\?P?<\w")


def key_of(field: str) -> str | None:
    """The attribute that a field names, None for a column."""
    return None if field in FIELDS else field.removeprefix("attr.")


def text_of(field: str) -> Column:
    """A field as text, null where an attribute is missing."""
    key = key_of(field)
    return F.col(FIELDS[field]) if key is None else S.attr_text(S.attr(key))


def real_of(field: str) -> Column:
    return S.real(text_of(field))


def name_of(field: str) -> str:
    """The name of a field in results."""
    return FIELDS.get(field) or key_of(field)


def check_regex(pattern: str) -> str:
    """Java's form of a pattern (see `dialect`); ValueError if it is none, and for named groups, which a condition has no use for."""
    if m := NAMED.search(pattern):
        raise ValueError(f"unsupported in a regular expression: {m[0]}")
    return translate(pattern)


def pred(field: str, op: str, value: str | float | Sequence[str] | None = None) -> Column:
    """A condition on a field, true or false: op is one of = != > >= < <= like exists in regex. An attribute is read once."""
    return F.coalesce(held(field, op, value), F.lit(False))


def held(field: str, op: str, value: str | float | Sequence[str] | None = None, columns: Collection[str] = ()) -> Column:
    """As `pred`, but null instead of false where a filter takes both alike: conditions on columns then reach the files.

    columns: those of the table. An attribute that is stored in one of its own (see `sinks.with_typed`) is looked up there, and
    in the map only for rows from files without that column.
    """
    key = key_of(field)
    if key is None:
        return _condition(field, F.col(FIELDS[field]), None, op, value)
    own = f"{TYPED}{key}"
    if own in columns and f"{own}#" in columns and (quick := _typed(F.col(f"`{own}`"), F.col(f"`{own}#`"), op, value)) is not None:
        lacking = F.col(f"`{own}`").isNull()
        return (quick | lacking) & (~lacking | _of_map(field, key, op, value))  # the first part reaches the files
    return _of_map(field, key, op, value)


def _of_map(field: str, key: str, op: str, value) -> Column:
    if op == "exists":
        return S.bound(S.attr(key), S.present)
    text = lambda v: S.bound(v.cast("string"), lambda t: S.attr_text(v, t))
    return S.bound(S.attr(key), lambda v: S.bound(text(v), lambda t: _condition(field, t, v, op, value)))


def _typed(text: Column, number: Column, op: str, value) -> Column | None:
    """The condition on an attribute's own columns; None for those that only its map tells."""
    if op == "=" and str(value).lower() not in ("true", "false") and not str(value).startswith(ABSENT):
        return text == str(value)
    if op == "in" and value and not any(str(x).startswith(ABSENT) for x in value):
        return text.isin(*[str(x) for x in value])
    if op == "exists":
        return text != ABSENT
    if op in COMPARE and S.NUMBER.match(str(value)) is not None:
        return COMPARE[op](number, F.lit(float(value)))
    return None


def _condition(field: str, text: Column, v: Column | None, op: str, value) -> Column:
    """text: the field's text; v: the variant, of an attribute."""

    def equals(wanted: str) -> Column:
        if field == "level":
            wanted = wanted.lower()
        if v is not None and wanted.lower() in ("true", "false"):
            return S.present(v) & (S.is_bool(v) | (F.schema_of_variant(v) == "STRING")) & (F.lower(v.cast("string")) == wanted.lower())
        return text == wanted

    if op == "=":
        return equals(str(value))
    if op == "!=":
        same = equals(str(value))
        return text.isNull() | (~same if v is None else ~F.coalesce(same, F.lit(False)))
    if op in COMPARE:
        literal = str(value)
        numeric = S.NUMBER.match(literal) is not None
        return COMPARE[op](S.real(text), F.lit(float(literal))) if numeric else COMPARE[op](text, F.lit(literal))
    if op == "like":
        return F.lower(text).like(S.like_pattern(str(value).lower()))
    if op == "exists":
        return text != ""
    if op == "in":
        values = [str(x).lower() if field == "level" else str(x) for x in value or ()]
        return text.isin(*values) if values else F.lit(False)
    if op == "regex":
        return F.rlike(text, F.lit(check_regex(str(value))))
    raise ValueError(f"unknown operator {op!r}")


def resolve_bounds(inner: tuple, outer: tuple, now: datetime, last: timedelta | None = None) -> tuple[datetime | None, datetime | None]:
    """(start, end): an inner bound replaces the outer one, each by itself; `last` counts back from the end, or from now."""
    end = inner[1] or outer[1]
    start = (end or now) - last if last is not None else inner[0] or outer[0]
    return start, end


def within(df: DataFrame, start: datetime | None, end: datetime | None) -> DataFrame:
    """Both bounds included; also by the partition column dt, where there is one."""
    for bound, op in ((start, operator.ge), (end, operator.le)):
        if bound is not None:
            df = df.where(op(F.col("ts"), F.lit(bound)))
            if "dt" in df.columns:
                df = df.where(op(F.col("dt"), F.to_date(F.lit(bound))))
    return df


def search(df: DataFrame, filters: Iterable[tuple | Column] = (), terms: Iterable[str] = (), start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    """The rows that all filters, terms and bounds hold for; the same for batches and streams."""
    conditions = [f if isinstance(f, Column) else held(*f, columns=df.columns) if len(f) == 3 else held(*f, None, columns=df.columns) for f in filters]
    terms = list(terms)
    if terms:
        found = X.holds(X.searchable(), terms)  # rows may come without their normal text
        conditions.append(F.coalesce(X.all_terms(F.col("text_norm"), terms), found) if "text_norm" in df.columns else found)
    df = within(df, start, end)
    return df.where(reduce(operator.and_, conditions)) if conditions else df


def display_text() -> Column:
    """One line of a row: its message, or else the raw text."""
    return F.replace(F.coalesce(F.nullif(F.col("message"), F.lit("")), F.col("raw")), F.lit("\n"), F.lit(" "))
