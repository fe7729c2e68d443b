"""Syslog lines, RFC 5424 and RFC 3164, as Column expressions. Nothing is dropped: what fits no form is a message."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.functions import scalars as S

#: Names by number.
FACILITIES = "kern user mail daemon auth syslog lpr news uucp cron authpriv ftp ntp audit alert clock local0 local1 local2 local3 local4 local5 local6 local7".split()
SEVERITIES = "emerg alert crit err warning notice info debug".split()
NEW = r"^1 (\S+) (\S+) (\S+) (\S+) (\S+) ?"
ELEMENT = r'\[((?:[^"\]]|"(?:\\.|[^"\\])*")*)\]'
ELEMENTS = r'^((?:\[(?:[^"\]]|"(?:\\.|[^"\\])*")*\])+|-)(?: |$)'
PARAM = r'([^ =\]"]+)="((?:\\.|[^"\\])*)"'
OLD = r"^(?:([A-Z][a-z]{2} +\d{1,2} \d{2}:\d{2}:\d{2})|(\d{4}-\d{2}-\d{2}T\S+)) (\S+) "
TAG = r"^([^ :\[]{1,48})(?:\[([^\]]*)\])?: ?"


def _name(names: list[str], k: Column) -> Column:
    return F.get(F.array(*map(F.lit, names)), k.cast("int"))


def structured(data: Column) -> Column:
    """map<string,string> of structured data: id.name of each parameter, id=true of an element without any."""

    def one(element: Column) -> Column:
        ident = F.regexp_extract(element, r"^(\S+)", 1)
        names = F.regexp_extract_all(element, F.lit(PARAM), F.lit(1))
        values = F.regexp_extract_all(element, F.lit(PARAM), F.lit(2))
        pairs = F.zip_with(names, values, lambda k, v: F.struct(F.concat(ident, F.lit("."), k).alias("k"), F.regexp_replace(v, r'\\(["\\\]])', "$1").alias("v")))
        return F.when(F.size(names) == 0, F.array(F.struct(ident.alias("k"), F.lit("true").alias("v")))).otherwise(pairs)

    pairs = F.flatten(F.transform(F.regexp_extract_all(data, F.lit(ELEMENT), F.lit(1)), one))
    unique = F.transform(F.array_distinct(F.transform(pairs, lambda p: p["k"])), lambda k: F.struct(k.alias("k"), F.element_at(F.filter(pairs, lambda p: p["k"] == k), -1)["v"].alias("v")))
    return F.map_from_entries(unique)


def year_of(stamp: Column, now: Column) -> Column:
    """A stamp without a year takes the year of receipt, or the one before if that is over a day ahead."""
    squeezed = F.regexp_replace(stamp, " +", " ")
    here = F.try_to_timestamp(F.concat(F.date_format(now, "yyyy "), squeezed), F.lit("yyyy MMM d HH:mm:ss"))
    before = F.try_to_timestamp(F.concat((F.year(now) - 1).cast("string"), F.lit(" "), squeezed), F.lit("yyyy MMM d HH:mm:ss"))
    return F.when(here.isNull() | (here > now + F.expr("INTERVAL 24 HOURS")), before).otherwise(here)


def parse_syslog(df: DataFrame, col: str = "value", *, now: datetime) -> DataFrame:
    """Logs of a text column; ids follow from a row's place (`file` and `line_no`), see `S.placed`."""
    at = F.lit(now).cast("timestamp")
    given = lambda c: F.when(~c.isin("-", ""), c)
    rows = S.placed(df).select(F.regexp_replace(F.col(col), "[\\r\\n\\x00]+$", "").alias("raw"), "file", "line_no")
    pri = F.regexp_extract("raw", r"^<(\d{1,3})>", 1).try_cast("int")
    rows = rows.withColumn("pri", F.when(pri <= 191, pri))
    rows = rows.withColumn("body", F.when(F.col("pri").isNotNull(), F.regexp_replace("raw", r"^<\d{1,3}>", "")).otherwise(F.col("raw")))
    rows = rows.withColumn("new", F.col("pri").isNotNull() & F.rlike("body", F.lit(NEW))).withColumn("old", F.col("pri").isNotNull() & ~F.col("new") & F.rlike("body", F.lit(OLD)))
    rows = rows.withColumn("rest", F.when(F.col("new"), F.regexp_replace("body", NEW, "")).when(F.col("old"), F.regexp_replace("body", OLD, "")))
    part = lambda k: given(F.regexp_extract("body", NEW, k))
    data = F.regexp_extract("rest", ELEMENTS, 1)
    tagged = F.col("old") & F.rlike("rest", F.lit(TAG))
    message = (
        F.when(F.col("new"), F.regexp_replace(F.when(data != "", F.expr("substring(rest, length(regexp_extract(rest, r'" + ELEMENTS.replace("'", "\\'") + "', 0)) + 1)")).otherwise(F.col("rest")), "^\ufeff", ""))
        .when(tagged, F.regexp_replace("rest", TAG, ""))
        .when(F.col("old"), F.col("rest"))
        .otherwise(F.col("body"))
    )
    stamp = F.regexp_extract("body", OLD, 1)
    ts = F.when(F.col("new"), S.rfc3339(F.regexp_extract("body", NEW, 1))).when(F.col("old"), F.when(stamp != "", year_of(stamp, at)).otherwise(S.rfc3339(F.regexp_extract("body", OLD, 2))))
    severity, facility = F.col("pri") % 8, F.floor(F.col("pri") / 8)
    pairs = {
        "facility": _name(FACILITIES, facility),
        "severity": _name(SEVERITIES, severity),
        "procid": F.when(F.col("new"), part(4)).when(tagged, given(F.regexp_extract("rest", TAG, 2))),
        "msgid": F.when(F.col("new"), part(5)),
    }
    own = F.map_filter(F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), v)]), lambda _, v: v.isNotNull())
    more = F.when(F.col("new") & data.startswith("["), structured(data)).otherwise(F.create_map().cast("map<string,string>"))
    whole = F.map_concat(F.map_filter(own, lambda k, _: ~F.map_contains_key(more, k)), more)
    return rows.select(
        S.event_id(at, F.col("file"), F.col("line_no"), F.col("raw")).alias("id"),
        F.coalesce(ts, at).alias("ts"),
        at.alias("received_at"),
        F.coalesce(F.when(F.col("new"), part(2)).when(F.col("old"), F.regexp_extract("body", OLD, 3)), F.lit("")).alias("source"),
        F.coalesce(F.when(F.col("new"), part(3)).when(tagged, F.regexp_extract("rest", TAG, 1)), F.lit("")).alias("service"),
        S.level_norm(severity.cast("string")).alias("level"),
        message.alias("message"),
        F.transform_values(whole, lambda _, v: v.cast("variant")).alias("attributes"),
        "raw",
    )


def read_syslog(spark: SparkSession, path: str, *, now: datetime) -> DataFrame:
    """Logs of text files, a line each; blank lines are skipped."""
    from emberlog.sources.readers import numbered

    return parse_syslog(numbered(spark.read.text(path)).where(F.trim("value") != ""), now=now)
