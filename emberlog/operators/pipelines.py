"""Ordered enrichment: pipelines of stages, folded into one projection.

A pipeline runs if it is enabled and its filters match the row as earlier pipelines left it. A stage that fails is
skipped; with fail_pipeline it ends its pipeline, whose earlier edits stay. No row is ever lost.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.functions import grok as G
from emberlog.functions import scalars as S
from emberlog.functions.predicates import FIELDS, key_of, pred, text_of

TYPES = ("grok", "regex", "timestamp", "level", "service", "rename", "remove", "set")
#: Layouts tried in turn, after RFC 3339; `y` marks one without a year.
LAYOUTS = ("yyyy-MM-dd HH:mm:ss[.SSSSSSSSS] Z z", "yyyy-MM-dd HH:mm:ss,SSS", "yyyy-MM-dd HH:mm:ss[.SSSSSSSSS]", "dd/MMM/yyyy:HH:mm:ss Z", "y:yyyy MMM d HH:mm:ss", "dd MMM yyyy HH:mm:ss Z")
ROUTED = {"message": "message", "service": "service", "source": "source", "host": "source", "level": "level"}


@dataclass(frozen=True)
class Stage:
    """type: see TYPES. layouts: Java patterns of the timestamp stage, instead of LAYOUTS."""

    type: str
    field: str = "message"
    pattern: str = ""
    to: str = ""
    value: str = ""
    fields: tuple[str, ...] = ()
    layouts: tuple[str, ...] = ()
    fail_pipeline: bool = False


@dataclass(frozen=True)
class Pipeline:
    name: str
    stages: tuple[Stage, ...]
    match: tuple = field(default=())
    enabled: bool = True
    order: int = 0


def validate(pipelines: Sequence[Pipeline]) -> None:
    """ValueError for the first fault, before any plan is made."""
    for p in pipelines:
        if not p.stages:
            raise ValueError(f"{p.name}: no stages")
        for m in p.match:
            pred(*m)
        for s in p.stages:
            if s.type not in TYPES:
                raise ValueError(f"{p.name}: unknown stage {s.type!r}")
            if s.type in ("grok", "regex"):
                if not s.pattern:
                    raise ValueError(f"{p.name}: {s.type} needs a pattern")
                names = G.numbered(G.expand(s.pattern) if s.type == "grok" else s.pattern)[1]
                if not names:
                    raise ValueError(f"{p.name}: the pattern names no field")
            if s.type == "rename" and not (s.field and s.to):
                raise ValueError(f"{p.name}: rename needs a field and a new name")
            if s.type == "remove" and not s.fields:
                raise ValueError(f"{p.name}: remove needs fields")
            if s.type == "set" and not s.to:
                raise ValueError(f"{p.name}: set needs a name")


def valid(pipelines: Sequence[Pipeline]) -> list[Pipeline]:
    """The pipelines that `validate` has nothing against."""
    out = []
    for p in pipelines:
        try:
            validate([p])
        except ValueError:
            continue
        out.append(p)
    return out


def read_field(name: str) -> Column:
    """A field's text; an empty column counts as missing, an empty attribute doesn't."""
    return F.nullif(text_of(name), F.lit("")) if key_of(name) is None else text_of(name)


def parse_time(text: Column, received: Column, layouts: Sequence[str] = ()) -> Column:
    """An epoch integer, or the first layout that fits; one without a year takes the year of receipt."""
    squeezed = F.regexp_replace(F.trim(text), r"\s+", " ")
    plain = F.regexp_replace(squeezed, r"^\w{3}, ", "")
    year = F.concat(F.date_format(received, "yyyy"), F.lit(" "), plain)
    tried = [] if layouts else [S.rfc3339(plain)]
    for x in layouts or LAYOUTS:
        tried.append(F.try_to_timestamp(year, F.lit(x[2:])) if x.startswith("y:") else F.try_to_timestamp(plain, F.lit(x)))
    return F.when(F.rlike(squeezed, F.lit(r"^\d+$")), S.epoch_to_ts(squeezed.try_cast("decimal(38,9)"))).otherwise(F.coalesce(*tried))


Edits = dict[str, Column]


def _stage(s: Stage) -> tuple[Column, Edits]:
    """(whether the stage succeeds, new values of columns if it does); a pattern's stage reads its match from _parts."""
    text = read_field(s.field)
    if s.type in ("grok", "regex"):
        _, places = _match(s)
        ok, found = G.is_match(F.col("_parts")), {n: G.capture(F.col("_parts"), k) for n, k in places.items()}
        edits: Edits = {}
        for name in [n for n in found if n in ROUTED]:
            column, cap = ROUTED[name], found.pop(name)
            edits[column] = F.when(cap != "", S.level_norm(cap) if column == "level" else cap).otherwise(F.col(column))
        return ok, edits | ({"attributes": S.set_texts(F.col("attributes"), found)} if found else {})
    if s.type == "timestamp":
        ts = parse_time(text, F.coalesce("received_at", "ts"), s.layouts)
        return ts.isNotNull(), {"ts": ts}
    if s.type == "level":
        return text.isNotNull(), {"level": S.level_norm(text)}
    if s.type == "service":
        return text.isNotNull(), {"service": text}
    if s.type == "rename":
        key = key_of(s.field)
        kept = S.drop_keys(F.col("attributes"), key) if key is not None else F.col("attributes")
        edits = {"attributes": S.set_key(kept, s.to.removeprefix("attr."), S.of_text(text))}
        return text.isNotNull(), edits if key is not None else edits | {FIELDS[s.field]: F.lit("")}
    if s.type == "remove":
        keys = [key_of(f) for f in s.fields if key_of(f) is not None]
        edits = {FIELDS[f]: F.lit("") for f in s.fields if key_of(f) is None}
        return F.lit(True), edits | ({"attributes": S.drop_keys(F.col("attributes"), *keys)} if keys else {})
    return F.lit(True), {"attributes": S.set_key(F.col("attributes"), s.to.removeprefix("attr."), S.of_text(F.lit(s.value)))}


def _match(s: Stage) -> tuple[Column, dict[str, int]]:
    return G.matched(read_field(s.field), G.expand(s.pattern) if s.type == "grok" else s.pattern)


def _run(df: DataFrame, pipelines: Sequence[Pipeline], note: Callable[[DataFrame, Pipeline, Stage | None], DataFrame]) -> DataFrame:
    validate(pipelines)
    df = df.drop("text_norm", *(c for c in df.columns if c.startswith(S.TYPED)))  # made of what stages change
    for p in sorted((p for p in pipelines if p.enabled), key=lambda p: p.order):
        match = reduce(lambda a, b: a & b, [pred(*m) for m in p.match], F.lit(True))
        df = note(df.withColumn("_alive", match), p, None)
        for s in p.stages:
            ok, edits = _stage(s)
            if s.type in ("grok", "regex"):
                df = df.withColumn("_parts", _match(s)[0])
            df = df.withColumn("_ok", F.coalesce(ok, F.lit(False)))
            go = F.col("_alive") & F.col("_ok")
            df = df.withColumns({c: F.when(go, v).otherwise(F.col(c)) for c, v in edits.items()})
            df = note(df, p, s)
            if s.fail_pipeline:
                df = df.withColumn("_alive", go)
        df = df.drop("_alive", "_ok", "_parts")
    return df


def apply_pipelines(df: DataFrame, pipelines: Sequence[Pipeline]) -> DataFrame:
    return _run(df, pipelines, lambda d, p, s: d)


def dry_run(df: DataFrame, pipelines: Sequence[Pipeline]) -> DataFrame:
    """df enriched, with the names of pipelines that matched and the errors of stages."""

    def note(d: DataFrame, p: Pipeline, s: Stage | None) -> DataFrame:
        if s is None:
            return d.withColumn("matched", F.when(F.col("_alive"), F.array_append("matched", F.lit(p.name))).otherwise(F.col("matched")))
        failed = F.col("_alive") & ~F.col("_ok")
        return d.withColumn("errors", F.when(failed, F.array_append("errors", F.lit(f"{p.name}: {s.type} failed on {s.field}"))).otherwise(F.col("errors")))

    empty = F.array().cast("array<string>")
    return _run(df.withColumns({"matched": empty, "errors": empty}), pipelines, note)
