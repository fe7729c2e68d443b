"""Grok and named-group patterns, rewritten once to a Java regular expression with numbered groups."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.functions.dialect import translate

MAX_DEPTH = 20
#: The built-in patterns.
PATTERNS = {
    "WORD": r"\b\w+\b",
    "NOTSPACE": r"\S+",
    "SPACE": r"\s*",
    "DATA": r".*?",
    "GREEDYDATA": r".*",
    "INT": r"(?:[+-]?(?:[0-9]+))",
    "NUMBER": r"(?:[+-]?(?:[0-9]+(?:\.[0-9]+)?))",
    "BASE16NUM": r"(?:0[xX])?[0-9a-fA-F]+",
    "UUID": r"[A-Fa-f0-9]{8}-(?:[A-Fa-f0-9]{4}-){3}[A-Fa-f0-9]{12}",
    "QS": r'"(?:[^"\\]|\\.)*"',
    "IPV4": r"(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)",
    "IPV6": r"(?:[A-Fa-f0-9]{0,4}:){2,7}[A-Fa-f0-9]{0,4}",
    "IP": r"(?:%{IPV6}|%{IPV4})",
    "HOSTNAME": r"\b(?:[0-9A-Za-z][0-9A-Za-z-]{0,62})(?:\.(?:[0-9A-Za-z][0-9A-Za-z-]{0,62}))*\b",
    "IPORHOST": r"(?:%{IP}|%{HOSTNAME})",
    "PORT": r"\b(?:[0-9]{1,5})\b",
    "URIPATH": r"(?:/[^\s?#]*)",
    "URIPARAM": r"\?\S*",
    "URIPROTO": r"[A-Za-z]+(?:\+[A-Za-z+]+)?",
    "HTTPVERB": r"\b(?:GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS|TRACE|CONNECT)\b",
    "HTTPVER": r"HTTP/[0-9.]+",
    "HTTPSTATUS": r"\b[1-5][0-9]{2}\b",
    "YEAR": r"(?:\d{4})",
    "MONTHNUM": r"(?:0?[1-9]|1[0-2])",
    "MONTHDAY": r"(?:0?[1-9]|[12][0-9]|3[01])",
    "HOUR": r"(?:2[0123]|[01]?[0-9])",
    "MINUTE": r"(?:[0-5][0-9])",
    "SECOND": r"(?:(?:[0-5]?[0-9]|60)(?:[:.,][0-9]+)?)",
    "TIME": r"%{HOUR}:%{MINUTE}:%{SECOND}",
    "ISO8601_TIMEZONE": r"(?:Z|[+-]%{HOUR}(?::?%{MINUTE})?)",
    "TIMESTAMP_ISO8601": r"%{YEAR}-%{MONTHNUM}-%{MONTHDAY}[T ]%{TIME}%{ISO8601_TIMEZONE}?",
    "MONTH": r"\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\b",
    "SYSLOGTIMESTAMP": r"%{MONTH} +%{MONTHDAY} %{TIME}",
    "HTTPDATE": r"%{MONTHDAY}/%{MONTH}/%{YEAR}:%{TIME} [+-][0-9]{4}",
    "LOGLEVEL": r"(?:[Aa]lert|ALERT|[Tt]race|TRACE|[Dd]ebug|DEBUG|[Nn]otice|NOTICE|[Ii]nfo|INFO|[Ww]arn(?:ing)?|WARN(?:ING)?|[Ee]rr(?:or)?|ERR(?:OR)?|[Cc]rit(?:ical)?|CRIT(?:ICAL)?|[Ff]atal|FATAL|[Ee]merg(?:ency)?|EMERG(?:ENCY)?)",
    "LOGGER": r"[A-Za-z0-9_.$/-]+",
}
REFERENCE = re.compile(r"%\{(\w+)(?::([\w.@-]+))?\}")
#: What a pattern is made of, as far as groups are concerned: escapes, classes, openings of groups.
PIECE = re.compile(r"\\.|\[\^?\]?(?:\\.|[^\]\\])*\]|\(\?P?<(?P<name>[A-Za-z][\w.]*)>|\((?P<plain>(?!\?))", re.S)


def expand(pattern: str, depth: int = 0) -> str:
    """The pattern with every reference replaced; a reference with a field becomes a named group."""
    if depth > MAX_DEPTH:
        raise ValueError("grok patterns refer to each other without end")

    def one(m: re.Match) -> str:
        if m[1] not in PATTERNS:
            raise ValueError(f"unknown grok pattern {m[1]!r}")
        inner = expand(PATTERNS[m[1]], depth + 1)
        return f"(?P<{m[2]}>{inner})" if m[2] else f"(?:{inner})"

    return re.sub(REFERENCE, one, pattern)


def numbered(pattern: str) -> tuple[str, dict[str, int]]:
    """A pattern without group names, and the number of each named group."""
    names: dict[str, int] = {}
    count = 0

    def one(m: re.Match) -> str:
        nonlocal count
        if m["name"]:
            count += 1
            names.setdefault(m["name"], count)
            return "("
        if m["plain"] is not None:
            count += 1
        return m[0]

    # names may hold dots, which no engine takes in a group's name
    out = re.sub(PIECE, one, re.sub(r"\(\?P?<([\w.@-]+)>", lambda m: f"(?P<{m[1]}>", pattern))
    out = translate(out, allow="Z")
    return out, names


SEPARATOR = "\x01"


def matched(col: Column, pattern: str) -> tuple[Column, dict[str, int]]:
    """(an array, the place in it of each named group's text); of a text that doesn't match the array has one element.

    The expression runs once: a match of the whole text, from its first match on, is replaced by its groups with
    separators, which are split. A text that holds the separator itself is read group by group.
    """
    java, names = numbered(pattern)
    before = "" if java.startswith("^") and "|" not in java else r"(?s:.*?)"
    joined = F.regexp_replace(col, rf"^{before}(?:{java})(?s:.*)\z", SEPARATOR + SEPARATOR.join(f"${k}" for k in names.values()))
    by_group = F.array(F.lit(""), *[F.regexp_extract(col, java, k) for k in names.values()]) if names else F.array(F.lit(""), F.lit(""))
    slow = F.when(F.rlike(col, F.lit(java)), by_group).otherwise(F.array(col))
    return F.when(F.contains(col, F.lit(SEPARATOR)), slow).otherwise(F.split(joined, SEPARATOR)), {n: i for i, n in enumerate(names, 1)}


def is_match(parts: Column) -> Column:
    return F.coalesce(F.size(parts) > 1, F.lit(False))


def capture(parts: Column, place: int) -> Column:
    """A group's text of `matched`, empty where the group is missing."""
    return F.coalesce(F.get(parts, F.lit(place)), F.lit(""))


def captures(col: Column, pattern: str) -> tuple[Column, dict[str, Column]]:
    """(whether it matches, text of each named group, empty where the group is missing)."""
    parts, names = matched(col, pattern)
    return is_match(parts), {n: capture(parts, k) for n, k in names.items()}


def grok(col: Column, pattern: str) -> dict[str, Column]:
    return captures(col, expand(pattern))[1]


def with_captures(df: DataFrame, col: str, pattern: str) -> DataFrame:
    """df with a column for each named group of a grok pattern."""
    parts, names = matched(F.col(col), expand(pattern))
    return df.withColumn("_parts", parts).withColumns({n: capture(F.col("_parts"), k) for n, k in names.items()}).drop("_parts")
