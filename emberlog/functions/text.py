"""Free text: tokens, phrases with a prefix at the end, and an inverted index."""

from __future__ import annotations

import operator
import unicodedata
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.functions import scalars as S
from emberlog.functions.scalars import attr_text

NO_TOKEN = r"[^\p{L}\p{Nd}]+"


def tokens(col: Column) -> Column:
    """Runs of letters and digits, lower-cased."""
    return F.filter(F.split(F.lower(col), NO_TOKEN), lambda t: t != "")


def normal(col: Column) -> Column:
    """The tokens in one line, each after a blank."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(col), NO_TOKEN, " ")))


def searchable() -> Column:
    """Message, raw, service, source, then attributes by key."""
    entries = F.array_sort(F.map_keys(F.coalesce("attributes", F.create_map().cast("map<string,variant>"))))
    each = F.transform(entries, lambda k: F.concat_ws(" ", k, attr_text(F.col("attributes")[k])))
    return F.concat_ws(" ", "message", "raw", "service", "source", F.array_join(each, " "))


def text_norm() -> Column:
    return normal(searchable())


def split_tokens(text: str) -> list[str]:
    """As `tokens`: runs of letters and decimal digits."""
    kept = (c if unicodedata.category(c)[0] == "L" or unicodedata.category(c) == "Nd" else " " for c in text.lower())
    return "".join(kept).split()


def term(text: Column, wanted: str) -> Column:
    """Whether normal text holds the tokens of `wanted` in a row, the last as a prefix; no token, no match."""
    found = split_tokens(wanted)
    return F.contains(text, F.lit(" " + " ".join(found))) if found else F.lit(False)


def all_terms(text: Column, terms: Iterable[str]) -> Column:
    """Whether normal text holds every term."""
    return reduce(operator.and_, [term(text, t) for t in terms], F.lit(True))


def holds(text: Column, terms: Iterable[str]) -> Column:
    """Whether a text holds every term. Text is made normal once, and only where it holds the letters of all tokens."""
    terms = list(terms)
    letters = sorted({t for wanted in terms for t in split_tokens(wanted)})

    def once(s: Column) -> Column:
        quick = S.bound(F.lower(s), lambda low: reduce(operator.and_, [F.contains(low, F.lit(t)) for t in letters], F.lit(True)))
        return quick & S.bound(normal(s), lambda t: all_terms(t, terms))

    return S.bound(text, once)


def build_index(df: DataFrame, text: Column | None = None) -> DataFrame:
    """(token, id): each token of a row once."""
    source = text if text is not None else searchable()
    return df.select("id", F.explode(F.array_distinct(tokens(source))).alias("token")).select("token", "id")


def write_index(df: DataFrame, path: str, text: Column | None = None) -> None:
    """Stores an index, in order of its tokens, so that a search reads only the files and row groups that may hold its own."""
    build_index(df, text).repartitionByRange("token").sortWithinPartitions("token").write.mode("overwrite").parquet(path)


def search_index(index: DataFrame, terms: Iterable[str]) -> DataFrame:
    """Ids of rows that hold every token of the terms, the last of each term as a prefix. Phrases want `term` on top."""
    wanted = [(w, k == len(ws) - 1) for ws in map(split_tokens, terms) for k, w in enumerate(ws)]
    if not wanted:
        return index.select("id").where(F.lit(False))
    index = index.where(reduce(operator.or_, [F.col("token").startswith(w) if last else F.col("token") == w for w, last in wanted]))
    hit = F.array(*[F.when(F.col("token").startswith(w) if last else F.col("token") == w, F.lit(k)) for k, (w, last) in enumerate(wanted)])
    found = index.select("id", F.explode(F.array_compact(hit)).alias("k"))
    return found.groupBy("id").agg(F.count_distinct("k").alias("n")).where(F.col("n") == len(wanted)).select("id")


def semi(df: DataFrame, hits: DataFrame) -> DataFrame:
    return df.join(hits, "id", "left_semi")
